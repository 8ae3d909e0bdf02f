"""Secret scans: known forms, and strings that pass a battery of randomness tests.

Known forms are an assignment to a secret's name, an access key and a long run of hex digits; their
spans are leftmost and do not overlap within a kind.

Further candidates are long runs of encoding characters outside those spans; ``=`` belongs to a run
only as padding at its end, so a name and the value after it are two runs. The encoding is inferred
from the characters (hex, base32, base36 in one case, or base64, all with letters and digits); runs
of letters alone are words. A candidate's characters become numbers, and three tests ask
whether they could be uniform: chi-squared over equal cells of the alphabet, runs above and below
its middle, and serial correlation. Their smallest p-value is multiplied by three. Over all
candidates of one encoding and length band, the Benjamini-Hochberg rule finds the p-values too
small for random strings at a false-discovery rate ``RATE``; the other candidates are secrets. The
p-values meet that rule as counts per (encoding, band, step), a table of bounded size: ``STEPS`` steps
for each power of ten down to ``LEAST_P``, where a p-value counts as its step's upper edge, at most
1.2% above it.

All of it is built-in expressions over one text; positions come from the lengths of the matches and
of the pieces between them.

Defined cases: a null or empty text has no spans; repeated rows are scanned each; a null id is
kept; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ensure_columns, staged, text_or_empty

# The known forms, their shortest lengths and their order in lists of spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}(?:={1,6}(?![A-Za-z0-9+/=_-]))?"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
CELLS, BANDS, STEPS, RATE = 4, 16, 200, 0.05
LEAST_P = 1e-16  # what doubles tell from 0 in 1 - p


def _located(text: Column, pattern: str, value_group: int = 0) -> Column:
    """All leftmost matches: structs ``start, end, value``, in code points from 0."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.split(text, pattern, -1)
    placed = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"), values.alias("value")),
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"),
        ),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["match"])).alias("at"),
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(x["gap"])).alias("start"),
                        (acc["at"] + F.length(x["gap"]) + F.length(x["match"])).alias("end"),
                        x["value"].alias("value"),
                    )
                ),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), placed).otherwise(none)


def _phi(z: Column) -> Column:
    """The normal distribution function, by a logistic approximation."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return 2 * (1 - _phi(F.least(F.abs(z), F.lit(12.0))))


def encoding(value: Column) -> Column:
    """The encoding a candidate looks like; null for words and mixtures."""
    body = F.regexp_replace(value, r"=+$", "")
    letters, digits = body.rlike("[A-Za-z]"), body.rlike("[0-9]")
    return (
        F.when(~letters | ~digits, None)
        .when(body.rlike(r"^[0-9a-f]+$") | body.rlike(r"^[0-9A-F]+$"), "hex")
        .when(body.rlike(r"^[A-Z2-7]+$"), "base32")
        .when(body.rlike(r"^[0-9a-z]+$") | body.rlike(r"^[0-9A-Z]+$"), "base36")
        .when(body.rlike("[a-z]") & body.rlike("[A-Z]") & body.rlike(r"^[A-Za-z0-9+/_-]+$"), "base64")
    )


def randomness(value: Column, kind: Column) -> Column:
    """The p-value of the battery for ``value`` as a uniform string of encoding ``kind``."""
    body = F.translate(F.regexp_replace(value, r"=+$", ""), "-_", "+/")
    body = F.when(kind.isin("hex", "base36"), F.lower(body)).otherwise(body)
    alphabet, size = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, letters in ALPHABETS.items():
        alphabet = F.when(kind == name, letters).otherwise(alphabet)
        size = F.when(kind == name, len(letters)).otherwise(size)
    letters = F.filter(F.split(body, ""), lambda c: c != "")
    places = F.transform(letters, lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double"))

    def battery(x: Column, n: Column) -> Column:
        middle = (size - 1) / 2.0
        spread = (size * size - 1) / 12.0
        expected = n / CELLS

        def excess(cell: int) -> Column:
            found = F.size(F.filter(x, lambda v: F.floor(v * CELLS / size) == cell))
            return F.pow(found - expected, F.lit(2)) / expected

        chi = reduce(lambda a, b: a + b, [excess(cell) for cell in range(CELLS)])
        df = CELLS - 1
        wilson = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
        pairs = F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("a"), F.slice(x, F.lit(2), F.size(x) - 1).alias("b"))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] > middle) != (p["b"] > middle)))
        runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        products = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - middle) * (p["b"] - middle))
        serial = products / (spread * F.sqrt(n - 1))
        uniform = 1 - _phi(F.least(wilson, F.lit(12.0)))
        return F.least(F.lit(1.0), 3 * F.least(uniform, _two_sided(runs), _two_sided(serial)))

    return F.get(
        F.transform(F.array(places), lambda x: battery(x, F.size(x).cast("double"))), F.lit(0)
    )


def _key(kind: Column, length: Column) -> Column:
    band = F.least(F.floor(length / 8), F.lit(BANDS - 1)).cast("string")
    return F.concat_ws(":", kind, band)


def _step(p: Column) -> Column:
    """The step of a p-value; larger for smaller ones."""
    return F.floor(-F.log10(F.greatest(p, F.lit(LEAST_P))) * STEPS).cast("int")


def scan_texts(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``known`` spans with their kind, and ``candidates`` with their p-value."""
    ensure_columns(docs, "doc_id", "text")
    text = F.col("text")
    located = docs.select("doc_id", text_or_empty("text").alias("text")).select(
        "doc_id",
        F.filter(_located(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_LEAST).alias("assign"),
        _located(text, ACCESS).alias("access"),
        _located(text, HEX).alias("hex"),
        _located(text, CANDIDATE).alias("runs"),
    )

    def tagged(kind: str) -> Column:
        return F.transform(
            F.col(kind),
            lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")),
        )

    known = F.array_sort(F.concat(tagged("assign"), tagged("access"), tagged("hex")))
    spanned = located.select("doc_id", known.alias("known"), "runs")
    free = F.filter(
        F.col("runs"),
        lambda m: ~F.exists(F.col("known"), lambda k: (k["start"] < m["end"]) & (m["start"] < k["end"])),
    )
    typed = F.filter(
        F.transform(
            free,
            lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
                encoding(m["value"]).alias("encoding"),
            ),
        ),
        lambda m: m["encoding"].isNotNull(),
    )
    judged = F.transform(
        F.col("typed"),
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["encoding"].alias("encoding"),
            _key(m["encoding"], F.length(m["value"])).alias("group"),
            _step(randomness(m["value"], m["encoding"])).alias("step"),
        ),
    )
    return spanned.withColumn("typed", typed).select("doc_id", "known", judged.alias("candidates"))


def cutoffs(scanned: DataFrame, rate: float = RATE) -> dict[str, int]:
    """Per group of candidates, the step of the largest p that the false-discovery rule rejects, if any."""
    counts = (
        scanned.select(F.explode("candidates").alias("c"))
        .groupBy("c.group", "c.step").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    groups: dict[str, list[tuple[int, int]]] = {}
    for row in counts:
        groups.setdefault(row["group"], []).append((row["step"], row["n"]))
    found = {}
    for group, steps in groups.items():
        total, below = sum(n for _, n in steps), 0
        for step, n in sorted(steps, reverse=True):
            below += n
            if 10 ** (-step / STEPS) <= rate * below / total:
                found[group] = step
    return found


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row: ``doc_id`` and ``spans`` (structs ``start, kind, end``, kind as a place in ``KINDS``)."""
    scanned = staged(scan_texts(docs), "secrets-scanned")
    cuts = cutoffs(scanned, rate)
    rejected = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]) if cuts else None
    passed = F.filter(
        F.col("candidates"),
        lambda c: F.lit(True) if rejected is None else rejected[c["group"]].isNull() | (c["step"] < rejected[c["group"]]),
    )
    random = F.transform(
        passed,
        lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")),
    )
    return scanned.select("doc_id", "known", F.array_sort(F.concat("known", random)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the known kinds, a digest of their spans and all spans as text."""
    found = find_secrets(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("known", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(spans_text(F.col("known")).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
