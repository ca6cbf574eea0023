"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  Queries and SQL live in
``seriesforge.llm.registry``.
"""
