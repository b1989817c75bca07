"""Grounded-retrieval analytics as DataFrame operators on Spark."""
