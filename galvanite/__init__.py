"""Keyed measurement analytics as Spark jobs."""
