"""The prefix trie against a trie built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolscope.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Rebuild every conversation, hang it into nested dictionaries, and sum by walking."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = prefix_trie._digest(role, text)
            own[conv].append(((turn is not None, turn or 0), digest, (role or "", text or "")))
    own = {c: [t for *_, t in sorted(found)] for c, found in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(np.fmod(c, 100)), [])
        turns = tuple(base[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        value = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = value + sum(saved[c] for c in children[node])
        leaves[node] = sum(leaves[c] for c in children[node]) if children[node] else 1
    return {
        (min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves[n],
         saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n in members
    }


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("depth", "slice", "i", "h", "f0")})
    trie = prefix_trie.prefix_trie(table, **options)
    assert trie.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in trie.collect()]
    assert len(got) == len(set(got))
    return set(got)


def talks(seed, n, longest=9):
    """Conversations of few different turns, some ids missing, so that prefixes meet in many ways."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 330), n):
        for k in range(rng.randint(1, longest)):
            rows.append((c, k, rng.choice(["user", "assistant"][k % 2 :]), rng.choice(["hi", "hello there", "ok"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_trie(spark, seed):
    rows = talks(seed, 90)
    assert found(spark, rows) == plain(rows)


def test_small_slices_and_hot_parents(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 3)
    rows = talks(3, 60) + [(5, 100 + k, "user", f"long {k % 4}") for k in range(40)]
    assert found(spark, rows, hot=4) == plain(rows)


def test_copies_of_whole_conversations(spark):
    rows = [(c, k, "user", f"turn {k}") for c in range(0, 260, 4) for k in range(4 + c % 3)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "nobody"), (1, None, None, None), (1, None, "user", "first"), (1, 2, "user", "twice"),
        (1, 2, "user", "twice"), (100, 0, "user", ""), (101, 0, "", "user"), (102, 5, "user", "x" * 300_000),
        (207, 0, "u", "base is absent"), (103, 0, None, "äöü 𝄞"), (103, 1, "a", None),
    ]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, 0, "user", "x")]) == set()


def test_meeting_fingerprints_are_noticed_and_taken_again(spark, monkeypatch):
    """With a base of zero modulo a small prime, most products meet; the proof must reject them."""
    honest = prefix_trie._rebuilt
    tried = []

    def weak_at_first(turns, bases):
        tried.append(bases)
        rows = honest(turns, bases)
        if len(tried) == 1:
            rows = rows.withColumns({f"f{k}": F.lit(0).cast("long") for k in range(3)})
        return rows

    monkeypatch.setattr(prefix_trie, "_rebuilt", weak_at_first)
    rows = talks(4, 30)
    assert found(spark, rows) == plain(rows)
    assert len(tried) == 2
