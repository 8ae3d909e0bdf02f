"""Substring dedup against a dictionary of all strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolscope.llm import suffix_dedup

SCHEMA = "doc_id long, text string"


def plain(rows):
    """Every string of 100 bytes in order; what was seen before marks its bytes."""
    def place(row):
        return (row[0] is not None, row[0] or 0, hash_of(row[1] or ""))

    def hash_of(text):
        return order[text]

    order = ORDER
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=place):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            piece = raw[k : k + 100]
            if piece in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


ORDER: dict[str, int] = {}


def compare(spark, rows):
    texts = sorted({t or "" for _, t in rows})
    hashes = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text").alias("h"))
    ORDER.clear()
    ORDER.update({r["text"]: r["h"] for r in hashes.collect()})
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("doc", "tie", "at", "copies", "rank")})
    got = suffix_dedup.remove_repeats(table)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    got = Counter((*r[:5], bytes(r[5])) for r in got.collect())
    expected = Counter(plain(rows))
    assert got - expected == Counter()
    assert expected - got == Counter()


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n))


def corpus(seed, n=150):
    """Texts that share passages of lengths around the limit, at all kinds of places."""
    rng = random.Random(seed)
    passages = [words(rng, 80)[: rng.choice([60, 99, 100, 101, 110, 149, 150, 151, 200, 400])] for _ in range(25)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, 20) if rng.random() < 0.5 else 0
            parts += [p[a:], words(rng, rng.randint(0, 8))]
        rows.append((rng.choice([i, i * 7 % 50]), "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_dictionary_of_all_strings(spark, seed):
    rows = list({i: t for i, t in corpus(seed)}.items())
    compare(spark, rows)


def test_repeated_ids_and_rows(spark):
    rows = corpus(4)
    compare(spark, rows + rows[:40] + [(None, t) for _, t in rows[:10]] + [(None, None)] * 3)


def test_repeats_of_few_bytes(spark):
    """Periodic texts, where every position is an anchor, and strings that overlap themselves."""
    rows = [(1, "a" * 350), (2, "a" * 99), (3, "ab" * 140), (4, "a" * 100), (5, "b" + "ab" * 60), (6, "x" * 130 + "a" * 130),
            (7, "abc" * 100 + "abd" * 100), (8, "bca" * 50), (9, "")]
    compare(spark, rows)


def test_bytes_beyond_ascii(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("äöüßé漢字𝄞 ") for _ in range(400))
    compare(spark, [(1, base), (2, "é" + base[50:200]), (3, "x" + base[10:90] + "y" + base[10:110]), (4, base[3:40])])


def test_pieces_and_blocks(spark, monkeypatch):
    """A long text over many pieces and blocks, and copies of it that are cut elsewhere."""
    rng = random.Random(7)
    long = words(rng, 4000)
    rows = [(1, long), (2, long[777:]), (3, words(rng, 30) + long[:9000] + words(rng, 500) + long[9000:]), (4, long)]
    raw = np.frombuffer(long.encode(), dtype=np.uint8)
    whole = suffix_dedup.anchors(raw, np.array([len(raw)]))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    suffix_dedup._powers.cache_clear()
    cut = suffix_dedup.anchors(raw, np.array([len(raw)]))
    suffix_dedup._powers.cache_clear()
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    monkeypatch.undo()
    compare(spark, rows)


def test_every_string_has_one_anchor_that_depends_on_it_alone():
    rng = random.Random(8)
    texts = [words(rng, 300).encode() for _ in range(3)]
    texts.append(b"short")
    texts.append(texts[0][100:900])
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    place, lo, hi = suffix_dedup.anchors(raw, ends)
    inside, start = {}, 0
    for t, end in zip(texts, ends, strict=True):
        valid = set(range(start, end - 99))
        of_text = [(p, a, b) for p, a, b in zip(place, lo, hi, strict=True) if start <= p < end]
        assert sum(b - a + 1 for _, a, b in of_text) == len(valid)
        for p, a, b in of_text:
            for k in range(a, b + 1):
                assert k in valid and 0 <= p - k <= 48
                assert inside.setdefault(raw[k : k + 100].tobytes(), p - k) == p - k
        start = end


def test_classes_over_the_borders_of_tasks(spark):
    """Few classes over many tasks: every border cuts one."""
    rows = spark.createDataFrame([(k % 3, k, 0, k) for k in range(500)] + [(7, 900, 0, 900)], "k1 long, doc long, tie long, at long")
    got = suffix_dedup.ranked(rows, ["k1"], []).collect()
    assert len(got) == 500
    classes = {}
    for r in got:
        classes.setdefault(r["rank"], []).append((r["doc"], r["later"]))
    assert len(classes) == 3
    for members in classes.values():
        assert len({d % 3 for d, _ in members}) == 1
        assert [d for d, later in members if not later] == [min(d for d, _ in members)]


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, ""), (None, "short")]):
        compare(spark, rows)


def test_runs_take_one_sort(spark, monkeypatch):
    """A passage of 1000 bytes in two texts: one sort of runs leaves only what lies at its ends."""
    rng = np.random.default_rng(5)
    passage, *own = (bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode() for n in (1000, 400, 400))
    docs = spark.createDataFrame([(i, f"{o}{passage}{o[::-1]}") for i, o in enumerate(own)], "doc_id long, text string")
    sorts, ranked = [], suffix_dedup.ranked
    monkeypatch.setattr(suffix_dedup, "ranked", lambda rows, keys, *a, **k: sorts.append("gaps" in keys) or ranked(rows, keys, *a, **k))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {0: 0, 1: 1000}
    assert sum(sorts) == 1
