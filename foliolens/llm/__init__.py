"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each operator takes and returns DataFrames;
``queries`` binds them to the driver's tables.
"""
