"""What the Python workers keep between stages."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from poolscope.llm import classifier, graph, ngram_join, packing, shared

ROOT = Path(__file__).resolve().parents[2]


def ran(code):
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    return subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_task_gives_its_memory_back():
    held = ran("""
import re
from pathlib import Path
from poolscope.llm.shared import released

def mb():
    return int(re.search(r"VmRSS:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) // 1024

kept = []

def task(batches):
    for batch in batches:
        many = [bytes(2000) for _ in range(100_000)]
        kept.append(bytes(2000))  # above them, so that the allocator alone returns nothing
        yield batch

before = mb()
assert list(released(task)([1, 2])) == [1, 2]
print(mb() - before)
""")
    assert int(held) < 50


def test_texts_without_special_tokens_load_no_second_tokenizer():
    loaded = ran("""
from poolscope.llm import packing
vocab, ranks = map(packing.vocabulary, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
packing.token_bytes("some words  and more", vocab, ranks)
print(packing._plain.cache_info().currsize, end=" ")
packing.token_bytes("some words <|endoftext|>", vocab, ranks)
print(packing._plain.cache_info().currsize)
""")
    assert loaded.split() == ["0", "1"]


def test_tasks_of_the_pipeline_give_their_memory_back(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    edges = spark.createDataFrame([(1, 2)], "a long, b long")
    found = []
    kind = type(docs)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, task, *rest, **more: found.append(task) or plain(df, task, *rest, **more))
    packing.pieces(docs)
    classifier.text_statistics(docs)
    ngram_join._set_classes(docs, 3)
    ngram_join._possible(docs, 3, 90)
    ngram_join._candidates(docs, 3, 90)
    assert len(found) == 6
    given = []
    monkeypatch.setattr(shared, "give_back", lambda: given.append(1))
    batch = pa.record_batch({"doc_id": pa.array([1, 2], pa.int64()), "text": pa.array(["a b c", None])})
    for task in found[:4]:
        assert list(task(iter([batch])))
    assert len(given) == 4
    graph.components(edges).collect()
    assert len(found) > 6
