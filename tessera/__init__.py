"""Tessera: a Spark-first engine for knowledge-graph entity linking."""
