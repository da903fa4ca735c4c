"""Readers: DataFrames over the tables, pages, lines and Markdown labels."""
from pagewright.sources.tables import latest, table

__all__ = ["latest", "table"]
