"""Operators for large training-data pipelines over text tables.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the query wrappers that bind them to the driver tables are in
:mod:`docengine.llm.queries`.
"""
