"""Spark-first analytics over collections of binary-derived text samples."""
