"""Readers and writers of corpora, queries, runs, qrels and reports."""
