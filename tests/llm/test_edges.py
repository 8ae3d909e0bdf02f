"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from poolscope.llm import (
    chat, classifier, fingerprints, licenses, line_dedup, mixing, ngram_join, packing, quality_rules, secrets,
)

LONG = " ".join(f"word{i} of the text" for i in range(20000))
PROSE = "the first line of a text\nthe second line of it\nand so on with many more words to come " * 4
ROWS = [
    (1, PROSE, "en", "a", 10, "x"),
    (1, PROSE, "en", "a", 10, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "b", 0, "y"),
    (4, LONG, "en", "a", 5, "z"),
    (5, PROSE, "de", "b", 7, "w"),
    (None, "an unknown document with words", "en", "a", 3, "v"),
    (None, None, None, None, None, None),
    (9, " \n\t ", "fr", None, 4, "u"),
    (10, "one", "fr", "c", 3, "t"),
]
# a column of each name that the operators use inside
CLASHES = ["size", "rate", "copies", "words", "lines", "host", "block", "place", "x", "id", "component", "known", "__other"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, note string"
LABELS = [(1, 1, 0), (3, 0, 0), (4, 1, 0), (5, 1, 1), (10, 0, 0), (None, 1, 0), (2, None, None), (77, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", None), (1, 1, "assistant", "[/INST] <\\s>\\"), (1, None, None, "first"),
        (None, 0, "assistant", "no id"), (2, 0, "</s>", "<s>[ROLE]"), (2, 0, "</s>", "<s>[ROLE]"), (3, 0, "user", ""),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))


OPERATORS = {
    "mixing": lambda d, l: mixing.mixing_table(d),
    "fingerprints": lambda d, l: fingerprints.fingerprint_documents(d),
    "licenses": lambda d, l: licenses.scan_licenses(d),
    "ngram_join": lambda d, l: ngram_join.ngram_components(d),
    "quality_rules": lambda d, l: quality_rules.judge_quality(d, l),
    "classifier": lambda d, l: classifier.score_documents(d, l),
    "secrets": lambda d, l: secrets.secret_report(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(docs, labels, name):
    got = OPERATORS[name](docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels).collect() == []
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).collect() == []


def test_packing_edges(docs):
    got = packing.pack_documents(docs).collect()
    assert sum(r["piece"] == 0 for r in got) == len(ROWS)
    assert [r["length"] for r in got if r["doc_id"] in (2, 3)] == [1, 1]
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_line_dedup_edges(docs):
    out = line_dedup.drop_boilerplate(docs, F.col("source"), counts=("n", "dropped"))
    assert out.columns == [*docs.columns, "n", "dropped"]
    got = out.collect()
    assert len(got) == len(ROWS)
    assert all((r["text"] is None) == (r["n"] == 0 and r["doc_id"] in (2, None) and r["source"] is None) for r in got if r["doc_id"] != 9)
    assert line_dedup.drop_boilerplate(docs.limit(0), F.col("source")).collect() == []


def test_lines_over_the_ratio_go_everywhere_in_their_site(spark):
    pages = [("a", f"shared\nown {i}\nshared\n") for i in range(4)] + [("a", f"own a{i}") for i in range(4)]
    pages += [("b", "shared\nelse")] + [("b", f"page {i}") for i in range(9)] + [(None, "shared")]
    frame = spark.createDataFrame(pages, "source string, text string")
    got = line_dedup.drop_boilerplate(frame, F.col("source"), ratio=0.4).collect()
    assert sorted(r["text"] for r in got if r["source"] == "a")[:1] == ["own 0\n"]
    assert [r["text"] for r in got if r["source"] != "a" and "shared" in r["text"]] == ["shared\nelse", "shared"]


@pytest.mark.parametrize("url, host", [
    ("http://A.example.com:80/x", "a.example.com"), ("https://u:p@b.org?q", "b.org"), ("no url", None), (None, None),
])
def test_hosts(spark, url, host):
    frame = spark.createDataFrame([(url,)], "url string")
    assert frame.select(line_dedup.host_of(F.col("url"))).first()[0] == host


def test_chat_edges(turns):
    import hashlib

    chats = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    assert set(chats) == {1, 2, 3, None}
    assert chat.read_turns(chats[1]["formatted"]) == [
        ("", "first"), ("user", "hello"), ("assistant", ""), ("assistant", "[/INST] <\\s>\\"),
    ]
    assert chat.read_turns(chats[2]["formatted"]) == [("</s>", "<s>[ROLE]")] * 2
    report = {r["conv_id"]: r for r in chat.chat_report(chat.format_chats(turns)).collect()}
    assert report[1]["loss_sha256"] == hashlib.sha256("[/INST] <\\s>\\".encode()).hexdigest()
    assert chat.format_chats(turns.limit(0)).collect() == []


STAGE_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, docs, stage):
    function = dict(corpus_pipeline.STAGES)[stage]
    for frame in (docs, docs.limit(0)):
        out = function(spark, frame, "/root/testdata/sf0.001")
        if stage != "best-fit packing":
            assert out.columns == docs.columns
        assert out.count() >= 0


def test_near_duplicate_stage_keeps_one_of_each_class(spark, docs):
    out = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, "")
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 9, 10]
    assert ids.count(None) == 2


def test_near_duplicate_stage_tells_rows_of_one_id_apart(spark):
    other = "something else that is like no text before it"
    rows = [
        (7, PROSE, "a"), (7, other, "b"), (7, other, "a"), (7, other, "b"), (8, other, "c"),
        (None, PROSE, "d"), (None, LONG, "f"), (None, LONG, "e"), (None, LONG + " and", "e"), (None, "", "g"), (None, "", "g"),
    ]
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 5):
        got = [tuple(r) for r in stage(spark, docs.repartition(parts), "").collect()]
        assert sorted(r for r in got if r[0] is not None) == sorted([(7, PROSE, "a"), (7, other, "a")])
        unnamed = [r for r in got if r[0] is None]
        assert len(unnamed) == 3 and unnamed.count((None, "", "g")) == 2
        assert {r[1] for r in unnamed} <= {"", LONG, LONG + " and"}
