"""Declarative, incremental data indexing on Spark."""
