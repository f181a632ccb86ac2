"""Relational operators of ranked retrieval and its evaluation."""
