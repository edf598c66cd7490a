"""Curation, duplicate analysis and faceted search of text records on Spark DataFrames."""

__version__ = "0.1.0"
