"""Spark-first analytics for grid x week panels and training-text corpora."""
