"""Petition validation and field analytics as Spark jobs."""
