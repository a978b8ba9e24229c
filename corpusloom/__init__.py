"""Spark-first analytics over collections of code and text."""
