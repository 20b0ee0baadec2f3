"""Trackmill: event and trajectory analytics expressed as Spark DataFrame plans."""
