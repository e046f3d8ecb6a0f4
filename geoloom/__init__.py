"""Spatial and tabular data pipelines as ordinary Spark jobs."""
