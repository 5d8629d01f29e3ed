"""Checks of large collections of academic documents and their references, as Spark jobs."""
