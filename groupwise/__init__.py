"""Keyed-group analytics on Spark."""
