"""Spectral experiment analytics as Spark DataFrame operators."""
