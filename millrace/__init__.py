"""Curation of synthetic text datasets as Spark jobs."""
