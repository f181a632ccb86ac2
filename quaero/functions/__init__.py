"""Scalar functions: text analysis, arrays and vectors, JSON, distributions."""
