"""Spark-first analytics for document and bibliographic corpora."""
