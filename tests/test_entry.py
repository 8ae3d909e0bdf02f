"""The driver's entry point with and without the optional training-data part."""

from __future__ import annotations

import importlib
import sys

import pytest

import __spark_entry__ as entry_point
from poolscope.catalog import ENTRIES, ORACLES, Entry


def test_entry_without_the_optional_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(entry_point)
    assert set(bare.queries()) == set(ENTRIES) == set(bare.oracle_sql())
    monkeypatch.undo()
    importlib.reload(entry_point)


def test_a_missing_oracle_is_an_error():
    assert not (ORACLES / "no_such_query.sql").exists()
    with pytest.raises(FileNotFoundError):
        Entry(lambda t: None).oracle("no_such_query")
