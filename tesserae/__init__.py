"""Spatial-omics analytics on Spark: points, pixels, shapes and annotation tables as DataFrames."""

__version__ = "0.1.0"
