"""Classifiers trained and applied as Spark jobs."""
