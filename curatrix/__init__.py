"""Curatrix: a Spark-first engine for curating text training data."""
