"""Lodestream: data-mining operators for PySpark DataFrames."""

__version__ = "0.1.0"
