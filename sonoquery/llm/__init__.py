"""Operators of a training-data pipeline.

Nothing outside this package imports it.  The queries are in
:mod:`sonoquery.llm.queries`.
"""
