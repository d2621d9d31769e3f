"""Ordered sequences, record streams and sets as plain Spark plans."""
