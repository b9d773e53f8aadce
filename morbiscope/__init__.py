"""Spark-first analytics for event-surveillance tables and training-data preparation."""
