"""Quality rules: text statistics and a learned, ordered decision list.

The statistics are built-in expressions over one document each. The list is learned by sequential
covering from labelled statistics: a rule is a conjunction of thresholds, grown one condition at a
time for the largest information gain on the growing fold, cut back to the prefix that does best
on the pruning fold, and accepted while its precision there holds; then the rows it covers are set
aside. The result is an ordered ``CASE`` expression.

Each step is one aggregation of the labelled rows into counts per (statistic, bin), at most
``len(SHARES) * (BINS + 1)`` rows, which are all that the driver sees. Every labelled row counts.

Defined cases: a null text is empty; a text without words has shares of 0; unlabelled rows and
null labels teach nothing; a label given twice counts twice; without labels the list is empty and
keeps all; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, ensure_columns, staged, text_or_empty, words_of

SHARES = (
    "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "mean_word", "upper_share",
    "digit_share", "shout_share", "words_per_line",
)
BINS = 40
MAX_RULES, MAX_CONDITIONS = 8, 3
MIN_PRECISION = 0.9
ACCURACY = 2000  # of the approximate percentiles that serve as cuts


def _sorted_windows(windows: Column) -> Column:
    """The windows of a text with their places in order of the hash; none if no window repeats."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(windows) > F.size(F.array_distinct(windows)), placed)


def _repeated_words(placed: Column) -> Column:
    """Number of word positions inside windows that occur twice or more, from sorted windows."""
    repeated = F.filter(
        placed,
        lambda x, j: (x["h"] == F.get(placed, j - 1)["h"]).eqNullSafe(True)
        | (x["h"] == F.get(placed, j + 1)["h"]).eqNullSafe(True),
    )
    places = F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.when(placed.isNull(), 0).otherwise(F.size(F.array_distinct(places)))


def text_statistics(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the counts and the shares the rules are made of."""
    ensure_columns(docs, "doc_id", "text")
    text, words, windows = F.col("text"), F.col("words"), F.col("windows")
    split = docs.select("doc_id", text_or_empty("text").alias("text")).select(
        "doc_id", "text", words_of(text).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
    )
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).alias("n_upper"),
        F.regexp_count(text, F.lit(r"[0-9]+")).alias("n_digits"),
        F.regexp_count(text, F.lit(r"!+")).alias("n_shouts"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"),
    )
    hashes = F.col("hashes")
    windowed = counted.withColumn(
        "windows",
        F.when(
            F.size(hashes) >= 3,
            F.transform(
                F.slice(hashes, F.lit(1), F.size(hashes) - 2),
                lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    placed = windowed.withColumn("placed", _sorted_windows(windows)).drop("hashes", "windows")
    counts = placed.withColumn("n_repeat_words", _repeated_words(F.col("placed")).cast("long"))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("word_chars", "n_words").alias("mean_word"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_digits", "n_words").alias("digit_share"),
        share("n_shouts", "n_words").alias("shout_share"),
        share("n_words", "n_lines").alias("words_per_line"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _all(conditions: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in conditions], F.lit(True))


def _cuts(labelled: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: percentiles of each statistic over the bad and over the good rows."""
    probabilities = [i / (BINS // 2 + 1) for i in range(1, BINS // 2 + 1)]
    picked = [
        F.percentile_approx(F.when(F.col("bad") == bad, F.col(f)), probabilities, ACCURACY).alias(f"{f}_{int(bad)}")
        for f in SHARES
        for bad in (True, False)
    ]
    row = labelled.agg(*picked).first()
    return {f: sorted({float(v) for bad in (0, 1) for v in row[f"{f}_{bad}"] or ()}) for f in SHARES}


def _binned(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Add ``bins``: per statistic the number of cuts below its value."""
    def place(feature: str) -> Column:
        values = F.array(*[F.lit(c) for c in cuts[feature]]).cast("array<double>")
        return F.size(F.filter(values, lambda c: F.col(feature) > c))

    return rows.withColumn("bins", F.array(*[place(f) for f in SHARES]))


def _gain(bad: int, good: int, was_bad: int, was_good: int) -> float:
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(was_bad / (was_bad + was_good)))


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> Condition | None:
    """The threshold of the largest gain on the growing fold, ties by the order of ``SHARES``."""
    counted = (
        rows.where("grows")
        .select("bad", F.posexplode("bins").alias("feature", "bin"))
        .groupBy("feature", "bin")
        .agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    best, found = 1e-9, None
    for k, feature in enumerate(SHARES):
        table = sorted((r["bin"], r["bad"], r["n"] - r["bad"]) for r in counted if r["feature"] == k)
        all_bad, all_good = sum(r[1] for r in table), sum(r[2] for r in table)
        if not all_bad or not all_good:
            continue
        low_bad = low_good = 0
        for bin_, bad, good in table[:-1]:
            low_bad, low_good = low_bad + bad, low_good + good
            for above, b, g in ((False, low_bad, low_good), (True, all_bad - low_bad, all_good - low_good)):
                if (gain := _gain(b, g, all_bad, all_good)) > best:
                    best, found = gain, Condition(feature, above, cuts[feature][bin_])
    return found


def _pruned(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix that does best on the pruning fold, with the bad and good rows it covers there."""
    sums = []
    for k in range(1, len(rule) + 1):
        for label in ("bad", "good"):
            wanted = F.col("bad") if label == "bad" else ~F.col("bad")
            sums.append(F.count(F.when(_all(rule[:k]) & wanted, 1)).alias(f"{label}{k}"))
    row = rows.where("not grows").agg(*sums).first()
    covered = [(row[f"bad{k}"], row[f"good{k}"], k) for k in range(1, len(rule) + 1)]
    bad, good, k = max(covered, key=lambda c: ((c[0] - c[1]) / max(1, c[0] + c[1]), c[0], -c[2]))
    return rule[:k], bad, good


def learn_rules(statistics: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list for ``quality = 0``, from ``statistics`` and ``labels`` joined on ``doc_id``."""
    labelled = (
        labels.select("doc_id", (F.col("quality") == 0).alias("bad"))
        .where(F.col("bad").isNotNull())
        .join(statistics.select("doc_id", *SHARES), "doc_id")
        .withColumn("grows", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(3)) < 2)
    )
    rest = staged(labelled, "rules-labelled")
    cuts = _cuts(rest)
    rest = staged(_binned(rest, cuts), "rules-binned")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            condition = _best_condition(rest.where(_all(rule)), cuts)
            if condition is None:
                break
            rule += (condition,)
        if not rule:
            break
        rule, bad, good = _pruned(rest, rule)
        if not bad or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(rule)
        rest = rest.where(~_all(rule))
    return rules


def first_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that a row meets, from 1; null if it meets none."""
    if not rules:
        return F.lit(None).cast("int")
    number = F.when(_all(rules[0]), 1)
    for k, rule in enumerate(rules[1:], 2):
        number = number.when(_all(rule), k)
    return number


def apply_rules(statistics: DataFrame, rules: list[Rule], min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Add ``base_failed``, ``rule`` (the first that rejects) and ``kept``."""
    repeated = 100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")
    return (
        statistics.withColumn("base_failed", (F.col("n_words") < min_words) | repeated)
        .withColumn("rule", first_rule(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of ``docs``, the list being learned from ``labels``."""
    ensure_columns(labels, "doc_id", "quality")
    statistics = staged(text_statistics(docs), "rules-statistics")
    return apply_rules(statistics, learn_rules(statistics, labels))
