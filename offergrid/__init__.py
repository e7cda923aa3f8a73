"""Catalog analytics over scheduled offerings, as Spark DataFrame operators."""
