"""Lodestone: document retrieval and corpus analytics on PySpark DataFrames."""

__version__ = "0.1.0"
