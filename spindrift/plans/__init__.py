"""Whole pipelines: hybrid retrieval, index runs, the mapping of tables to units."""
