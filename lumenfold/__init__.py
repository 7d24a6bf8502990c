"""Spark jobs over measurements derived from images, and over training-data corpora (subpackage llm)."""
