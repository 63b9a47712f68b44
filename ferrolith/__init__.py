"""Structural element, drawing and member-model analytics as Spark jobs."""
