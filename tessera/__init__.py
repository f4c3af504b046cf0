"""Tessera: sequence-panel and training-data analytics as Spark jobs."""
