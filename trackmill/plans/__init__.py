"""Queries built from the operators."""
