"""Queries, rewriting and storage of large collections of annotated trees on Spark."""
