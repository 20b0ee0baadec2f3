"""Relational building blocks of trajectory analytics."""
