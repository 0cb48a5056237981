"""Relational, raster and statistical operators."""
