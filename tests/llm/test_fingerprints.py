"""Fingerprints and likenesses against plain Python over the same hashes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from functools import reduce
from operator import xor

import pytest
import regex
import xxhash

from poolscope.llm import fingerprints
from poolscope.llm.fingerprints import EACH, LEAST_PARTS, LEVELS, SUBSETS


def hash_of(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64(data, seed=seed).intdigest()


def terms(text):
    return {hash_of(w.encode()) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def short(value: int) -> str:
    return f"{hash_of(value.to_bytes(8, 'little')) % 2**32:08x}"


def kept_by(term: int, k: int) -> bool:
    return hash_of(k.to_bytes(4, "little"), hash_of(term.to_bytes(8, "little"))) % 2 ** (k // EACH + 1) == 0


def parts(text, lexicon):
    every = terms(text)
    known = every & lexicon
    if not known:
        # an aggregate over no term at all is null, whose hash is the seed
        spare = short(reduce(xor, every)) if every else f"{42:08x}"
        return ["x" + spare] * (1 + SUBSETS)
    subsets = [[t for t in known if kept_by(t, k)] for k in range(SUBSETS)]
    return [short(reduce(xor, known))] + [short(reduce(xor, s)) if s else "" for s in subsets]


def likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    best = [0.0]
    for level in range(LEVELS):
        pairs = [(x, y) for x, y in zip(a[1:], b[1:], strict=True)][level * EACH : (level + 1) * EACH]
        some = [(x, y) for x, y in pairs if x or y]
        if len(some) >= LEAST_PARTS:
            best.append(sum(x == y for x, y in some) / len(some))
    return max(best)


def plain(rows, least=fingerprints.LEAST, most=fingerprints.MOST):
    ordered = sorted(rows)
    texts = [t or "" for _, t in ordered]
    counts = Counter(t for text in texts for t in terms(text))
    lexicon = {t for t, n in counts.items() if least * len(texts) <= n <= most * len(texts)}
    out = []
    for i, (doc_id, _) in enumerate(ordered):
        own, following = texts[i], texts[(i + 1) % len(texts)]
        cut = len(own) // 4
        edited = own[: len(own) - cut] + following[:cut]
        a, b, c = (parts(t, lexicon) for t in (own, edited, following))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc_id, len(own), sha, "-".join(a), "-".join(b), likeness(a, b), likeness(a, c)))
    return out


def corpus(ids, seed):
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(60)] + ["Größe", "naïve", "ΑΒΓ", "12", "x-y"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in ids]


@pytest.mark.parametrize(
    "ids",
    [
        list(range(70)),
        [n * 1024 + (n % 3) for n in range(40)],  # blocks of one row
        [random.Random(n).randint(-(2**62), 2**62) for n in range(60)],  # hashed ids
        [n % 7 for n in range(40)],  # repeated ids
    ],
    ids=["dense", "sparse", "hashed", "repeated"],
)
def test_equals_plain_fingerprints(spark, ids):
    rows = corpus(ids, 3) + [(2**62 + 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.fingerprint_documents(df)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    expected = plain([(i, t or "") for i, t in rows])
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_rows_without_an_id_are_spread_and_keep_their_texts(spark):
    rows = [(None, t) for _, t in corpus(range(300), 5)] + corpus(range(150), 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.fingerprint_documents(df).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    texts, _ = fingerprints.edited_texts(df)
    assert texts.where("doc_id is null").groupBy("block").count().agg({"count": "max"}).first()[0] < 80
    # every row has exactly one row before it, whose edited text ends with its start
    known = {t for _, t in rows}
    for r in texts.collect():
        cut = len(r["text"]) // 4
        assert any(r["edited"] == r["text"][: len(r["text"]) - cut] + t[:cut] for t in known)
