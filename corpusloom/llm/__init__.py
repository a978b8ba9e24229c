"""Operators for building training data from code and text."""
