"""Tabular analytics and supervised learning as PySpark DataFrame jobs."""

__version__ = "0.1.0"
