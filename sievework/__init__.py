"""Corpus preparation and evidence retrieval as Spark jobs."""
