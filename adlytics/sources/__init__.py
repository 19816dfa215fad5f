"""Inputs: driver tables, stand-in views, delimited text files."""

from adlytics.sources.tables import Tables, load_tables
from adlytics.sources.views import Views

__all__ = ["Tables", "load_tables", "Views"]
