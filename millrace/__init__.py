"""Millrace: document readiness, retrieval and corpus operators as Spark jobs."""
