"""Readers and writers; all go through Spark's own file access."""
