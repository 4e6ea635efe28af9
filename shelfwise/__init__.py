"""Catalogue cleaning, vector search and recommendation as plain Spark jobs."""
