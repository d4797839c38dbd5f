"""Annotated-sequence analytics on Spark DataFrames."""

from strandline.functions.columns import derive, dict_view, notes_with, qual, quals, xrefs
from strandline.sources.flatfile import find_flatfiles, read_flatfiles, tables

__version__ = "0.1.0"
__all__ = ["derive", "dict_view", "find_flatfiles", "notes_with", "qual", "quals", "read_flatfiles", "tables", "xrefs"]
