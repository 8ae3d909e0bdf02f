"""Mixing sources to target weights.

Words are summed per source, every source gets a target by its weight, and its repetition rate is
target over size. A document appears floor(rate) times, plus once more if its hash-seeded draw
falls below the fraction of the rate.

Only the totals of the sources, one row each, pass through a window over all sources. They are
written to a table first, so that the join back to the documents is a broadcast when that table
is small by its true size and otherwise a sort-merge join whose skewed keys adaptive execution
splits. A hot source therefore costs no more than any other.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a null
id draws like any other key; repeated rows draw alike; a source without words has rate 0; an empty
table gives an empty mix. Extra columns of the documents pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ensure_columns, staged, unit_draw, word_count

SEED = 20260


def rank_weights(totals: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Add ``weight``: the sources by code point, null last, take the weights of ``cycle`` in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in cycle])
    return totals.withColumn("weight", F.get(weights, place % len(cycle)))


def fill_targets(totals: DataFrame, share: float = 1.5, cap: int = 2) -> DataFrame:
    """Add ``target``: ``share`` of all words dealt out by weight, none above ``cap`` times its source.

    What a full source leaves over goes to the others by weight until none is above. That ends at
    one level per unit of weight, ``min(cap * size, level * weight)``. With the sources in the order
    in which they fill up, the level is the largest of (words left) / (weight left).
    """
    fills = Window.orderBy(F.col("size") * cap / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("size").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap
    rest = F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing))
    leveled = totals.withColumn("level", (F.sum("size").over(everything) * share - before) / rest)
    level = F.max("level").over(everything)
    return leveled.withColumn(
        "target", F.least((F.col("size") * cap).cast("double"), level * F.col("weight"))
    ).drop("level")


def source_plan(sizes: DataFrame, share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per source: ``source, source_size, target, rate``, from rows of ``source, size``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    plan = fill_targets(rank_weights(totals), share, cap)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    return plan.select("source", F.col("size").alias("source_size"), "target", rate.alias("rate"))


def copies(rate: Column, key: Column, seed: int = SEED) -> Column:
    """floor(rate), plus one with a probability equal to the fraction."""
    extra = F.when(unit_draw(key, seed) < rate - F.floor(rate), 1).otherwise(0)
    return (F.floor(rate) + extra).cast("int")


def mixing_table(docs: DataFrame, share: float = 1.5, cap: int = 2, seed: int = SEED) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, copies, taken``, without its text."""
    ensure_columns(docs, "doc_id", "source", "text")
    sizes = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mixing-sizes")
    plan = staged(source_plan(sizes, share, cap), "mixing-plan").withColumnRenamed("source", "plan_source")
    return (
        sizes.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
        .withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
        .select(
            "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
        )
    )


def mix_sources(docs: DataFrame, share: float = 1.5, cap: int = 2, seed: int = SEED) -> DataFrame:
    """The documents themselves, each repeated as the mix wants it, with their own columns."""
    ensure_columns(docs, "doc_id", "source", "text")
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    plan = staged(source_plan(sizes, share, cap), "mixing-plan")
    plan = plan.select(F.struct("source", "rate").alias("__mix"))
    repeated = F.explode(F.array_repeat(F.lit(True), copies(F.col("__mix.rate"), F.col("doc_id"), seed)))
    return (
        docs.join(plan, F.col("source").eqNullSafe(F.col("__mix.source")))
        .select(*[F.col(f"`{c}`") for c in docs.columns], repeated.alias("__copy"))
        .drop("__copy")
    )
