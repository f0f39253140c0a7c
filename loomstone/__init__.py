"""Loomstone: memory, retrieval and text analytics as Spark DataFrame operators."""
