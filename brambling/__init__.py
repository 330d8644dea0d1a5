"""Counting, search and ranking queries as Spark plans."""
