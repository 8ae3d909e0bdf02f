"""Ranked lexical search against plain scoring, and its interval reading on its own."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolscope.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, queries, k):
    """Every document scored for every query, by the formula as it stands."""
    bags = [(i, Counter(terms(text))) for i, text in docs if terms(text)]
    documents, length = len(bags), sum(sum(b.values()) for _, b in bags)
    holding = Counter(t for _, b in bags for t in b)
    rows = set()
    for item, text in queries:
        scored = []
        for i, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * documents) // length
            score = sum(
                math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[t] + 1)))
                * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t in terms(text) if bag[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        rows |= {(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)}
    return rows


def found(spark, docs, queries, k, **sizes):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "score": F.lit("y")})
    q = spark.createDataFrame(queries, "item_id long, text string").withColumn("query", F.lit("z"))
    rows = lexical.search(d, q, k, **sizes)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return [tuple(r) for r in rows.collect()]


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(n)], rng


def test_equals_plain_scores_over_many_segments(spark):
    docs, rng = corpus(900, 3)
    queries = [(i, " ".join(f"W{rng.randint(1, 40)}" for _ in range(rng.randint(1, 12)))) for i in range(25)]
    for segment in (300, 10**6):
        got = found(spark, docs, queries, 7, segment=segment)
        assert set(got) == plain(docs, queries, 7)
        assert len(got) == len(set(got))


def test_blocks_of_queries_change_nothing(spark):
    docs, rng = corpus(200, 4)
    queries = [(i, f"w{i % 9 + 1} w2 w2") for i in range(30)]
    assert set(found(spark, docs, queries, 5, chars=40)) == plain(docs, queries, 5)


def test_ties_are_ranked_by_id_across_segments(spark):
    docs = [(i, "same words here") for i in range(50, 0, -1)] + [(0, "other")]
    got = sorted(found(spark, docs, [(1, "words")], 4, segment=10))
    assert [(r, d) for _, r, d, _ in got] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert len({s for *_, s in got}) == 1


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "!!! ..."), (None, "Grüße term"), (5, "grüße TERM term"), (5, "term"), (5, "term"),
            (7, "term " * 50_000)]
    queries = [(None, "Term"), (1, None), (2, ""), (3, "absent"), (4, "GRÜßE"), (4, "GRÜßE"), (6, "GRÜSSE grüße")]
    expected = plain(docs, [(None, "Term"), (4, "GRÜßE"), (6, "GRÜSSE grüße")], 20)
    assert {r[:1] + r[2:] for r in found(spark, docs, queries, 20)} == {r[:1] + r[2:] for r in expected}
    assert {i for i, *_ in found(spark, docs, queries, 20)} == {None, 6}


def test_empty_tables(spark):
    assert found(spark, [], [(1, "word")], 3) == []
    assert found(spark, [(1, "word")], [], 3) == []
    assert found(spark, [(1, None)], [(1, "word")], 3) == []


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_interval_reading_equals_full_sums(data):
    n = data.draw(st.integers(1, 40))
    lists = []
    for _ in range(data.draw(st.integers(1, 6))):
        docs = data.draw(st.lists(st.integers(0, n - 1), min_size=1, max_size=n, unique=True))
        added = sorted((data.draw(st.integers(1, 6)) for _ in docs), reverse=True)
        lists.append((np.array(docs), np.array(added, dtype=np.int64)))
    k, bar = data.draw(st.integers(1, 8)), data.draw(st.integers(1, 9))
    totals = np.zeros(n, dtype=np.int64)
    for docs, added in lists:
        totals[docs] += added
    expected = [i for i in sorted(range(n), key=lambda i: (-totals[i], i)) if totals[i] >= bar][:k]
    best, scores = lexical.nra(lists, n, k, bar, block=data.draw(st.integers(1, 5)))
    assert best.tolist() == expected
    assert scores.tolist() == totals[expected].tolist()


def test_reading_stops_before_the_lists_end():
    """A clear winner that all lists show early leaves the tails unread."""

    n = 100_000
    docs = np.arange(n)
    added = np.concatenate([[10**9] * 3, np.ones(n - 3, dtype=np.int64)])
    reads = []

    class Spy:
        def __getitem__(self, span):
            reads.append(span.stop - span.start)
            return docs[span]

        def __len__(self):
            return n

    best, _ = lexical.nra([(Spy(), added), (Spy(), added)], n, 3)
    assert best.tolist() == [0, 1, 2]
    assert sum(reads) < 2000
