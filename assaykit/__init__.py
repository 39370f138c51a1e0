"""Spark-first provenance and measurement-mining engine."""
