"""Readers: rasters from Parquet, CSV tables, polygons, hashed file listings and synthetic data."""
