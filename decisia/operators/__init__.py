"""Operators on decision rows, samples, layouts and predictions."""
