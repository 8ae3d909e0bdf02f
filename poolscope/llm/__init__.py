"""Operators for preparing training data, each with a thin query in :mod:`poolscope.llm.catalog`."""
