"""Operators for large-scale training-data preparation, one module each.

Nothing outside this subpackage imports it.  ``lexaudit.llm.catalogue`` holds the
named queries and their SQL twins.
"""
