"""Spark-first lakehouse analytics: medallion operators, sources, streaming and plans."""
