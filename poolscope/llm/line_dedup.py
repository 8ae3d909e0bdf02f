"""Dropping boilerplate lines by their frequency within a site.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over
the number of its pages; lines above the ratio, on at least ``min_pages`` pages, are dropped
wherever they stand.

A page names each of its lines once, so pages per (host, line) is a plain count that is
pre-aggregated before the shuffle; a host with a third of all pages spreads over its lines. A host
cannot have more lines above the ratio than (mean lines per page) / ratio. These few are gathered
into one row per host, and pages meet their host's row: by broadcast when that table's true size
allows, otherwise by a sort-merge join that adaptive execution splits.

Lines are ended by ``\\n`` and compared as they are. Lines without a word are never counted and
never dropped.

Defined cases: a null text stays null and counts as a page without lines; a null host is a host of
its own; repeated rows are pages of their own; an empty table stays empty. Extra columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, ensure_columns, staged

RATIO, MIN_PAGES = 0.05, 3


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case and without its port; null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(found != "", F.lower(found))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host that has any: ``host, lines`` (sorted), from rows of ``host, text``."""
    lines = F.array_distinct(F.split(F.col("text"), "\n", -1))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    frequent = (
        pages.select("host", F.explode(lines).alias("line"))
        .where(F.col("line").rlike(WORD))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("found"))
        .where(F.col("found") >= min_pages)
    )
    totals = totals.withColumnRenamed("host", "total_host")
    return (
        frequent.join(totals, F.col("host").eqNullSafe(F.col("total_host")))
        .where(F.col("found") > F.col("pages") * ratio)
        .groupBy("host")
        .agg(F.array_sort(F.collect_list("line")).alias("lines"))
    )


def drop_boilerplate(
    docs: DataFrame,
    host: Column,
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with the boilerplate lines gone from ``text_col``.

    ``counts`` names two further columns: the lines of a page that have a word, and how many of
    them were dropped.
    """
    ensure_columns(docs, text_col)
    text = F.col(f"`{text_col}`")
    found = staged(boilerplate(docs.select(host.alias("host"), text.alias("text")), ratio, min_pages), "boilerplate")
    found = found.select(F.struct("host", "lines").alias("__bad"))
    joined = docs.join(found, host.eqNullSafe(F.col("__bad.host")), "left")
    hit = F.arrays_overlap(F.split(text, "\n", -1), F.col("__bad.lines"))
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda line: ~F.array_contains(F.col("__bad.lines"), line))
    cleaned = F.when(F.coalesce(hit, F.lit(False)), F.array_join(kept, "\n")).otherwise(text)
    out = joined.withColumn("__clean", cleaned)
    columns = [F.col("__clean").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        def worded(value: Column) -> Column:
            size = F.size(F.filter(F.split(value, "\n", -1), lambda line: line.rlike(WORD)))
            return F.when(value.isNull(), 0).otherwise(size).cast("long")

        before = worded(text)
        columns += [before.alias(counts[0]), (before - worded(F.col("__clean"))).alias(counts[1])]
    return out.select(*columns)
