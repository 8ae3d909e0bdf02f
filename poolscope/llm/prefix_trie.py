"""Prefix trie of rebuilt conversations from composable fingerprints.

A rebuilt conversation is the head of a base conversation and the rest of its own turns. No rebuilt
text is ever put together: a turn is known by a digest of its role and text, and a sequence of turns
by its product in a monoid. An element is ``(length, value)`` with the value modulo a prime, and
``(m, a) . (n, b) = (m + n, a + BASE ** m * b)``; three primes go side by side. So the product of a
base's head, found once per base, and the product of an own suffix, found once per conversation,
give the fingerprint of every rebuilt prefix, and that of its parent, by arithmetic alone.

1. Turns are digested where they are read, then numbered per conversation, and running products
   are taken, both in slices of ``SLICE`` turns whose sums are carried from slice to slice; no
   window ever holds the turns of a long conversation.
2. Rows with the same depth and fingerprint are a trie node. Each row keeps a reference to the
   stored turn it ends with. A node is proven: all its rows refer to equal turns, and their parents have one
   fingerprint, which by induction makes the sequences equal. If any node fails, the products are taken
   again with other bases.
3. A node is named by its smallest member and its depth, so the nodes of one name are a path that
   hangs below a node of a smaller name. What a subtree holds is then a sum over the
   node's members of what their own paths hold, cut at the node for its smallest member. So
   sums over subtrees are plain aggregations, however deep the trie is.
4. A join of many children with one parent is split: the nodes with more than ``HOT`` members, of which
   there are at most (rows / ``HOT``), are broadcast, the rest are joined by hash.

The ids of conversations that end in a node are hashed as a stream in their order, in one task per node,
which holds no more than the hash's state: the hash of a joined string has no parallel form.

Defined cases: a null role or text is empty; turns without a number come first, turns of one number
follow each other by digest, repeated turns are turns of their own; rows without a conversation id belong
to no conversation and are left out; a base that is absent gives no head; the remainder that leads
from an id to its base keeps the id's sign; an empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ensure_columns, staged

# The three largest primes below 2 ** 31: products of two residues fit a long.
PRIMES = (2147483647, 2147483629, 2147483587)
GROUP, HEADS = 100, 6  # a base serves this many ids; heads have fewer turns than HEADS
SLICE = 1024
HOT = 100_000

_VALUES = ("f0", "f1", "f2")
_NODE = ["depth", *_VALUES]


def head_length(conv_id: int) -> int:
    """How many turns of its base a conversation starts with."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _digest(role: str | None, text: str | None) -> bytes:
    own = (role or "").encode()
    return hashlib.blake2b(len(own).to_bytes(8, "little") + own + (text or "").encode(), digest_size=16).digest()


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, digest, n_chars``, one per turn; texts go no further."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([_digest(r, t) for r, t in zip(roles, texts, strict=True)], pa.binary()),
                    pa.array([len(t or "") for t in texts], pa.int64()),
                ],
                ["conv_id", "turn", "digest", "n_chars"],
            )

    known = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    return known.mapInArrow(digested, "conv_id long, turn long, digest binary, n_chars long")


def _carried(sums: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """``sums`` with ``values`` replaced by their totals over the slices before."""
    before = Window.partitionBy(key).orderBy(F.asc_nulls_first(at)).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns({v: F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values})


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their number ``i`` from 1 within the conversation."""
    cut = turns.withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(2**62))))
    order = Window.partitionBy("conv_id", "slice").orderBy(F.asc_nulls_first("turn"), "digest")
    before = _carried(cut.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n")), "conv_id", "slice", ["n"])
    local = cut.withColumn("local", F.row_number().over(order))
    return local.join(before, ["conv_id", "slice"]).select(
        "conv_id", (F.col("n") + F.col("local")).alias("i"), "digest", "n_chars"
    )


def _powers(base: int, prime: int, exponents: np.ndarray) -> np.ndarray:
    out = np.ones(len(exponents), dtype=np.int64)
    square, left = base % prime, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def _elements(numbered: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """Add ``h``, and the turn's terms in a head (``x..``, at ``i``) and in the own suffix (``y..``, after ``h``)."""
    names = [*(f"x{k}" for k in range(3)), *(f"y{k}" for k in range(3))]
    schema = "conv_id long, i long, digest binary, n_chars long, h long, " + ", ".join(f"{n} long" for n in names)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            every, where = np.unique(convs, return_inverse=True)
            h = np.array([head_length(c) for c in every.tolist()], dtype=np.int64)[where]
            words = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u4").reshape(-1, 4)
            turn = [words[:, k].astype(np.int64) % PRIMES[k] for k in range(3)]
            turn = [(t + words[:, 3].astype(np.int64) * (k + 1)) % PRIMES[k] for k, t in enumerate(turn)]
            columns = []
            for place in (i - 1, i - h - 1):
                inside = np.maximum(place, 0)
                columns += [
                    np.where(place < 0, 0, turn[k] * _powers(bases[k], PRIMES[k], inside) % PRIMES[k])
                    for k in range(3)
                ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(h), *[pa.array(c) for c in columns]],
                ["conv_id", "i", "digest", "n_chars", "h", *names],
            )

    return numbered.mapInArrow(terms, schema)


def _remainder(value: Column, k: int) -> Column:
    return F.pmod(value, F.lit(PRIMES[k]))


def _rebuilt(turns: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """Rows of all rebuilt prefixes: ``conv_id, depth, f.. , p.., digest, n_chars, ends``.

    ``f..`` is the fingerprint, ``p..`` that of the parent; ``ends`` marks the whole conversation.
    """
    every = [0, 1, 2]
    small = Window.partitionBy("base").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    heads = turns.where(F.col("i") < HEADS).select(
        F.col("conv_id").alias("base"), "i", "digest", "n_chars",
        *[_remainder(F.col(f"x{k}"), k).alias(f"x{k}") for k in every],
    )
    heads = heads.withColumns({f"f{k}": _remainder(F.sum(f"x{k}").over(small), k) for k in every})
    convs = turns.groupBy("conv_id").agg(F.first("h").alias("h"), F.max("i").alias("n"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    headed = convs.join(heads, "base").where(F.col("i") <= F.col("h"))
    last = headed.groupBy("conv_id").agg(F.max_by(F.struct(F.col("i").alias("m"), *_VALUES), "i").alias("head"))
    zero = F.struct(F.lit(0).cast("long").alias("m"), *[F.lit(0).cast("long").alias(v) for v in _VALUES])
    convs = convs.join(last, "conv_id", "left").withColumn("head", F.coalesce("head", zero))
    convs = convs.withColumn("whole", F.col("head.m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    wholes = convs.select("conv_id", "whole")
    root = wholes.select(
        "conv_id", F.lit(0).cast("long").alias("depth"),
        *[F.lit(0).cast("long").alias(f"{c}{k}") for c in "fp" for k in every],
        F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_chars"),
        (F.col("whole") == 0).alias("ends"),
    )
    shared = headed.join(wholes, "conv_id").select(
        "conv_id", F.col("i").cast("long").alias("depth"), *_VALUES,
        *[_remainder(F.col(f"f{k}") - F.col(f"x{k}"), k).alias(f"p{k}") for k in every],
        "digest", "n_chars", (F.col("i") == F.col("whole")).alias("ends"),
    )
    # own suffixes: running sums in slices, the sums of slices carried on with the head's product
    own = turns.where("i > h").withColumn("slice", F.floor(F.col("i") / SLICE))
    here = Window.partitionBy("conv_id", "slice").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = own.groupBy("conv_id", "slice").agg(*[F.sum(f"y{k}").alias(f"s{k}") for k in every])
    carried = _carried(sums, "conv_id", "slice", [f"s{k}" for k in every])
    carried = carried.join(convs.select("conv_id", "head", "whole"), "conv_id")
    joined = own.withColumns({f"r{k}": F.sum(f"y{k}").over(here) for k in every}).join(carried, ["conv_id", "slice"])

    def composed(k: int, before: int) -> Column:
        """The head's product times that of the suffix, up to this turn or the one before."""
        table = F.array(*[F.lit(pow(bases[k], m, PRIMES[k])).cast("long") for m in range(HEADS)])
        suffix = _remainder(F.col(f"s{k}") + F.col(f"r{k}") - (F.col(f"y{k}") if before else F.lit(0)), k)
        return _remainder(F.col(f"head.f{k}") + F.get(table, F.col("head.m").cast("int")) * suffix, k)

    depth = F.col("head.m") + F.col("i") - F.col("h")
    rest = joined.select(
        "conv_id", depth.alias("depth"),
        *[composed(k, 0).alias(f"f{k}") for k in every], *[composed(k, 1).alias(f"p{k}") for k in every],
        "digest", "n_chars", (depth == F.col("whole")).alias("ends"),
    )
    return root.unionByName(shared).unionByName(rest)


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per node, with the proof that its rows agree in ``proven``."""
    parents = [f"p{k}" for k in range(3)]
    ends = [F.min("digest").eqNullSafe(F.max("digest"))] + [F.min(p) == F.max(p) for p in parents]
    return rows.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars"),
        *[F.min(p).alias(p) for p in parents],
        reduce(lambda a, b: a & b, ends).alias("proven"),
    )


def _end_hashes(rows: DataFrame) -> DataFrame:
    """Per node with members that end there: the SHA-256 of their ids in order."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for *key, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key == current:
                    state.update(f",{conv}".encode())
                else:
                    if current is not None:
                        out.append((*current, state.hexdigest()))
                    current, state = key, hashlib.sha256(str(conv).encode())
            yield _end_batch(out)
        if current is not None:
            yield _end_batch([(*current, state.hexdigest())])

    ending = rows.where("ends").select(*_NODE, "conv_id")
    dealt = ending.repartition(*_NODE).sortWithinPartitions(*_NODE, "conv_id")
    return dealt.mapInArrow(hashes, "depth long, f0 long, f1 long, f2 long, ends_sha256 string")


def _end_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = [pa.int64()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*_NODE, "ends_sha256"]
    )


def _proven(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    for attempt in range(8):
        bases = tuple(1_000_003 + 7919 * (3 * attempt + k) + 2**29 for k in range(3))
        rows = staged(_rebuilt(_elements(turns, bases), bases), "trie-rows")
        nodes = staged(_nodes(rows), "trie-nodes")
        if nodes.where("not proven").isEmpty():
            return rows, nodes
    raise RuntimeError("fingerprints of different sequences met with every base")


def prefix_trie(conversations: DataFrame, hot: int = HOT) -> DataFrame:
    """Per trie node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    ensure_columns(conversations, "conv_id", "turn", "role", "text")
    rows, nodes = _proven(staged(_numbered(_turns(conversations)), "trie-turns"))
    own = [F.col(c) for c in _NODE]
    # children and parents
    above = [(F.col("depth") - 1).alias("depth"), *[F.col(f"p{k}").alias(f"f{k}") for k in range(3)]]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(
        nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-parents"
    )
    parents = nodes.select(*own, F.col("conv_id").alias("parent_conv_id"), (F.col("n_convs") > hot).alias("is_hot"))
    below = nodes.where("depth > 0").select(F.col("conv_id").alias("child"), F.col("depth").alias("at"), *above)
    common = below.join(F.broadcast(parents.where("is_hot")), _NODE, "left")
    named = common.where("parent_conv_id is not null").select("child", "at", "parent_conv_id").unionByName(
        common.where("parent_conv_id is null").drop("parent_conv_id", "is_hot")
        .join(parents.where("not is_hot"), _NODE).select("child", "at", "parent_conv_id")
    )
    # what the path of a name holds from each of its nodes down, in slices from the last one
    saved = (F.col("n_convs") - 1) * F.col("n_chars")
    paths = nodes.select("conv_id", "depth", saved.alias("saved"), (F.col("n_children") == 0).alias("leaf"))
    paths = paths.withColumn("slice", -F.floor(F.col("depth") / SLICE))
    sums = paths.groupBy("conv_id", "slice").agg(F.sum("saved").alias("later"))
    down = Window.partitionBy("conv_id", "slice").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("path", F.sum("later").over(Window.partitionBy("conv_id")))
    tails = paths.withColumn("local", F.sum("saved").over(down)).join(
        _carried(sums, "conv_id", "slice", ["later"]), ["conv_id", "slice"]
    )
    # by what a node's smallest member falls short of its whole path
    tails = tails.select(
        F.col("conv_id").alias("name"), F.col("depth").alias("level"),
        (F.col("local") + F.col("later") - F.col("path")).alias("tail"),
    )
    per_name = paths.groupBy("conv_id").agg(F.sum("saved").alias("path"), F.sum(F.col("leaf").cast("long")).alias("leaves"))
    # the slices of a long conversation meet its totals apart from each other
    sliced = rows.select(*own, "conv_id", F.floor(F.col("depth") / SLICE).alias("slice"))
    held = sliced.select("conv_id", "slice").distinct().join(per_name, "conv_id")
    totals = (
        sliced.join(held, ["conv_id", "slice"]).groupBy(*_NODE)
        .agg(F.sum("path").alias("paths"), F.sum("leaves").alias("n_leaves"))
    )
    whole = nodes.join(totals, _NODE).join(_end_hashes(rows), _NODE, "left")
    whole = whole.join(tails, (F.col("conv_id") == F.col("name")) & (F.col("depth") == F.col("level")))
    whole = whole.join(named, (F.col("conv_id") == F.col("child")) & (F.col("depth") == F.col("at")), "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("paths") + F.col("tail")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
