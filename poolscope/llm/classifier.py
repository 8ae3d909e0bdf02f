"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text are byte counts taken in numpy, one pass over each document. Standardised,
they go through random Fourier features, whose inner products approximate a Gaussian kernel. Each
of ``PARTS`` partitions sums its own normal equations; the driver adds ``PARTS`` matrices of fixed
size and solves the ridge system. The raw scores are calibrated by isotonic regression: rows of the
calibration fold are counted per score bin, and pool-adjacent-violators runs on ``BINS`` bins.

Labelled rows beyond ``SAMPLE`` are left out by hash, which bounds the fit; statistics and scores
cover every row of every text.

Only the text is an input. Rows whose crc32(doc_id) mod 5 is 0 are held out of everything learned.

Defined cases: a null or empty text has all statistics 0 and is scored like any other; a null id is
never labelled and is not held out; a label given twice counts twice; null labels are left out;
without usable labels every score is ``PRIOR``; repeated rows are scored each; an empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ensure_columns, released, staged

FEATURES, SEED, WIDTH, RIDGE = 192, 20260, 3.0, 1.0
SAMPLE, PARTS, BINS = 200_000, 16, 1000
THRESHOLD, PRIOR, FOLDS = 0.3, 0.5, 5
EDGE = 8192  # bytes at a time that the compression statistic sees

STATISTICS = (
    "log_words", "mean_word", "distinct_share", "top_word_share", "upper_share", "digit_share", "symbol_share",
    "mark_share", "stop_share", "other_share", "line_words", "dup_line_share", "squeeze", "repeat_share",
    "long_share", "worst_squeeze",
)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[[ord(c) for c in ".,;:"]] = 7
_CLASS[128:] = 8


def statistics(text: bytes) -> list[float]:
    """The values named in ``STATISTICS``."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=9)
    ink = max(1, len(text) - int(counts[1]))
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    blocks = [text[a : a + EDGE] for a in range(0, len(text), EDGE)]
    packed = [len(zlib.compress(b, 1)) for b in blocks]
    ratios = [p / (len(b) + 20) for p, b in zip(packed, blocks, strict=True) if len(b) >= EDGE // 8 or len(blocks) == 1]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        float(np.log1p(n)),
        ink / n,
        len(seen) / n,
        max(seen.values()) / n,
        counts[3] / ink,
        counts[2] / ink,
        counts[5] / ink,
        counts[6] / ink,
        counts[7] / ink,
        counts[8] / ink,
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        sum(packed) / (len(text) + 20),
        repeats / n,
        sum(len(w) > 24 for w in seen) / len(seen),
        min(ratios),
    ]


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text is a multiple of ``folds``; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def text_statistics(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, x`` (array of doubles)."""
    ensure_columns(docs, "doc_id", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(measure), "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to ``values``: pool adjacent violators."""
    blocks: list[list[float]] = []  # mean, weight, length
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(n), m) for m, _, n in blocks])


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, len(STATISTICS)))


def fit(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of ``quality = 1`` from the labelled rows that are not held out."""
    ensure_columns(labels, "doc_id", "quality")
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    usable = usable.where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id", F.lit(SEED))
    total = usable.count()
    if total > sample:
        usable = usable.where(F.pmod(order, F.lit(1_000_000)) < F.lit(int(1_000_000 * sample / total)))
    rows = usable.join(measured, "doc_id").withColumn("calibrates", F.pmod(F.shiftright(order, 20), F.lit(4)) == 0)
    rows = staged(rows.select("y", "calibrates", "x").repartition(PARTS), "classifier-sample")
    d = len(STATISTICS)
    moments = rows.select(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(d)],
        *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)],
        F.avg("y").alias("rate"),
    ).first()
    if not moments["n"] or moments["rate"] in (0.0, 1.0):
        return None
    rng = np.random.default_rng(SEED)
    model = Model(
        np.array([moments[f"m{i}"] for i in range(d)]),
        np.array([max(moments[f"s{i}"], 1e-6) for i in range(d)]),
        rng.normal(size=(d, FEATURES)) / WIDTH,
        rng.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + d + 1),
        np.array([0.0]),
        np.array([0.0]),
    )
    weights = _solve(rows.where("not calibrates"), model)
    model = Model(model.mean, model.scale, model.directions, model.phases, weights, model.knots, model.values)
    knots, values = _calibrate(rows.where("calibrates"), model)
    return Model(model.mean, model.scale, model.directions, model.phases, weights, knots, values)


def _solve(rows: DataFrame, model: Model) -> np.ndarray:
    width = len(model.weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            phi = model.features(_matrix(batch.column(1)))
            gram += phi.T @ phi
            moment += phi.T @ y
        packed = np.vstack([gram, moment]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["sums"])

    total = np.zeros((width + 1, width))
    for row in rows.select("y", "x").coalesce(PARTS).mapInArrow(released(sums), "sums binary").toLocalIterator():
        total += np.frombuffer(row["sums"]).reshape(width + 1, width)
    return np.linalg.solve(total[:width] + RIDGE * np.eye(width), total[width])


def _calibrate(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score knots and calibrated values, from counts per score bin."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch.column(1))), -0.5, 1.5)
            bins = ((raw + 0.5) / 2 * (BINS - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(0)], ["bin", "y"])

    counts = rows.select("y", "x").mapInArrow(released(binned), "bin int, y int")
    table = counts.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).orderBy("bin").collect()
    if not table:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    n = np.array([r["n"] for r in table], dtype=float)
    values = isotonic(np.array([r["good"] for r in table]) / n, n)
    return (np.array([r["bin"] for r in table]) + 0.5) / (BINS - 1) * 2 - 0.5, values


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``."""
    measured = staged(text_statistics(docs), "classifier-statistics")
    return _scored(measured, fit(measured, labels), threshold)


def _scored(measured: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    if model is None:
        rated = measured.select("doc_id", F.lit(PRIOR).alias("score"))
    else:
        rated = measured.mapInArrow(released(rate), "doc_id long, score double")
    return rated.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns.

    Every row is measured where it stands, once for the labels to meet the measures and once more to be
    judged; the texts cross no shuffle and are not written in between.
    """
    ensure_columns(docs, "doc_id", "text")
    model = fit(staged(text_statistics(docs), "classifier-statistics"), labels)
    if model is None:
        return docs if threshold <= PRIOR else docs.limit(0)
    at = docs.columns.index("text")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics((t.as_py() or "").encode()) for t in batch.column(at)]
            if rows:
                yield batch.filter(pa.array(model.score(np.array(rows)) >= threshold))

    return docs.mapInArrow(released(accept), docs.schema)
