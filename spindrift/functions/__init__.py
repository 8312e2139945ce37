"""Scalar functions as Spark columns; a few work on single driver-side strings."""
