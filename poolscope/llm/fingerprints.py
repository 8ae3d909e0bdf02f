"""Document fingerprints by I-Match over several randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band. A document's terms in
the lexicon are combined in a way that does not depend on their order, which gives what sorting them
first would give, in one aggregation; each of ``SUBSETS`` random subsets of the lexicon keeps some of
them, and their hash is one part of the fingerprint. There are ``EACH`` subsets on each of ``LEVELS`` levels,
which keep a half, a quarter and so on of the lexicon, so that short and long documents both have
parts that outlive an edit; one more part hashes all terms. The likeness of two fingerprints is the
share of equal parts on the level where it is highest, empty parts not counted.

A term of the band stands in at least a share ``LEAST`` of all documents, so the lexicon has at
most (mean distinct terms per document) / ``LEAST`` terms, however many documents there are. It is
written as a table and counted: up to ``BROADCAST`` terms of 16 bytes it is broadcast, beyond that
the planner chooses the join.

Documents are ordered by id in blocks of ids; only the first row of each block crosses to the
block before. So texts are shuffled once, and no task holds more than a block.

Defined cases: a null text is empty; a document without a term of the lexicon is hashed by all its
terms, so empty texts share a fingerprint; rows of one id follow each other by their text; rows
without an id come ahead of all others, by a hash of their text; the only row of a table follows
itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ensure_columns, staged, text_or_empty

LEAST, MOST = 0.001, 0.2
LEVELS, EACH, LEAST_PARTS = 8, 4, 2
SUBSETS = LEVELS * EACH
BLOCK_BITS = 10
BROADCAST = 1_000_000


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, as hashes."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """Rows ``term, mask``: terms in the band, with a bit for every subset that keeps them."""
    total = docs.count()
    kept = [
        F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(2 ** (k // EACH + 1))) == 0, F.lit(1 << k)).otherwise(0)
        for k in range(SUBSETS)
    ]
    return (
        docs.select(F.explode(terms_of(text_or_empty("text"))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        .where((F.col("df") >= least * total) & (F.col("df") <= most * total))
        .select("term", sum(kept[1:], kept[0]).cast("long").alias("mask"))
    )


def successors(ids: DataFrame) -> DataFrame:
    """Rows ``id, next``: every id with the next larger one, the largest with the smallest.

    ``ids`` has distinct longs in ``id``. They are dealt by range, so the last of a task takes the
    first of the next task, and only one row per task meets in one place.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(ids.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "fingerprint-order")
    led = dealt.withColumn("next", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    firsts = dealt.groupBy("part").agg(F.min("id").alias("first"))
    around = Window.orderBy("part")
    following = firsts.withColumn(
        "follow", F.coalesce(F.lead("first").over(around), F.min("first").over(Window.partitionBy()))
    )
    return led.join(following.select("part", "follow"), "part").select("id", F.coalesce("next", "follow").alias("next"))


def _neighbours(rows: DataFrame, value: str, blocks: DataFrame) -> DataFrame:
    """Add ``following``: ``value`` of the next row by (block, place), around the end of the table."""
    place = Window.partitionBy("block").orderBy("place")
    first = rows.where("place = 1").select(F.col("block").alias("next"), F.col(value).alias("first"))
    following = blocks.join(first, blocks["next"].eqNullSafe(first["next"])).select(
        F.col("id").alias("this"), "first"
    )
    led = rows.withColumn("following", F.lead(value).over(place))
    joined = led.join(following, F.col("block") == F.col("this"))
    return joined.withColumn("following", F.coalesce("following", "first")).drop("this", "first")


def edited_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``block, place, doc_id, text, edited``, and the successor of every block.

    In the edited text the last quarter of the code points gives way to as many (or all) from the
    start of the next document.
    """
    ensure_columns(docs, "doc_id", "text")
    text = text_or_empty("text")
    # ahead of all ids, and dealt by the text
    unnamed = F.lit(-(2**60)) + F.shiftright(F.xxhash64(text), 48)
    block = F.coalesce(F.shiftright(F.col("doc_id").cast("long"), BLOCK_BITS), unnamed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), block.alias("block"))
    blocks = staged(successors(rows.select(F.col("block").alias("id")).distinct()), "fingerprint-blocks")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("doc_id", "text")))
    near = _neighbours(placed, "text", blocks)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("following", F.lit(1), cut))
    return near.select("block", "place", "doc_id", "text", edited.alias("edited")), blocks


def _short(value: Column) -> Column:
    """Eight hex digits of a hash."""
    return F.lpad(F.lower(F.hex(F.pmod(value, F.lit(2**32)))), 8, "0")


def _combined(version: str, chosen: Column) -> list[Column]:
    """Aggregates: all terms combined, all of the lexicon, and those of each subset; null where there is none.

    Distinct terms in any order combine to the value that they give when sorted.
    """
    def over(condition: Column, name: str) -> Column:
        return F.bit_xor(F.when(chosen & condition, F.col("term"))).alias(f"{version}_{name}")

    known = F.col("mask").isNotNull()
    subsets = [over(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, str(k)) for k in range(SUBSETS)]
    return [over(F.lit(True), "spare"), over(known, "all"), *subsets]


def _parts(version: str) -> Column:
    """The hash of all terms and that of each subset's terms, '' where it keeps none."""
    def hashed(name: str) -> Column:
        return _short(F.xxhash64(F.col(f"{version}_{name}")))

    def part(k: int) -> Column:
        return F.when(F.col(f"{version}_{k}").isNotNull(), hashed(str(k))).otherwise("")

    return F.when(F.col(f"{version}_all").isNotNull(), F.array(hashed("all"), *[part(k) for k in range(SUBSETS)])).otherwise(
        F.array_repeat(F.concat(F.lit("x"), hashed("spare")), 1 + SUBSETS)
    )


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the share of equal parts on the best level with ``LEAST_PARTS`` parts or more."""
    def share(level: int) -> Column:
        pairs = F.arrays_zip(
            F.slice(a, 2 + level * EACH, EACH).alias("x"), F.slice(b, 2 + level * EACH, EACH).alias("y")
        )
        some = F.filter(pairs, lambda p: (p["x"] != "") | (p["y"] != ""))
        same = F.filter(some, lambda p: p["x"] == p["y"])
        return F.when(F.size(some) >= LEAST_PARTS, F.size(same) / F.size(some))

    return F.when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), 1.0).otherwise(
        F.coalesce(F.greatest(*[share(k) for k in range(LEVELS)]), F.lit(0.0))
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row: the fingerprints of its text and its edited text and their likeness."""
    words = staged(lexicon(docs), "fingerprint-lexicon")
    if words.count() <= BROADCAST:
        words = F.broadcast(words)
    texts, blocks = edited_texts(docs)
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    quarters = [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long").alias(f"sha{k}") for k in range(4)]
    own, changed = terms_of(F.col("text")), terms_of(F.col("edited"))
    carried = ["doc_id", "n_chars", *[f"sha{k}" for k in range(4)]]
    listed = texts.select(
        "block", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), *quarters,
        own.alias("own"), changed.alias("changed"),
    )
    # a term goes on once, with the versions that have it: both, the text, the edited text
    listed = listed.withColumn(
        "terms",
        F.array(F.array_intersect("own", "changed"), F.array_except("own", "changed"), F.array_except("changed", "own")),
    )
    each = listed.select("block", "place", *carried, F.posexplode("terms").alias("version", "terms"))
    single = each.select("block", "place", "version", *carried, F.posexplode_outer("terms").alias("at", "term"))
    # the document's own values on its first row alone
    first = (F.col("version") == 0) & (F.coalesce("at", F.lit(0)) == 0)
    single = single.select("block", "place", "version", "term", *[F.when(first, F.col(c)).alias(c) for c in carried])
    combined = single.join(words, "term", "left").groupBy("block", "place").agg(
        *[F.max(c).alias(c) for c in carried],
        *_combined("own", F.col("version") != 2), *_combined("changed", F.col("version") != 1),
    )
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"sha{k}")), 16, "0") for k in range(4)])
    prints = staged(
        combined.select(
            "block", "place", "doc_id", "n_chars", sha.alias("edited_sha256"),
            _parts("own").alias("own"), _parts("changed").alias("changed"),
        ),
        "fingerprints",
    )
    return _neighbours(prints, "own", blocks).select(
        "doc_id", "n_chars", "edited_sha256",
        F.array_join("own", "-").alias("fingerprint"),
        F.array_join("changed", "-").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
