"""Exact substring dedup by distributed prefix doubling over a sample of positions.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier: in a document before it, or
further ahead in the same one. Ranking every position by prefix doubling would sort all bytes of the
corpus once a round, dozens of times its size. So positions are sampled in a way that equal strings
agree on, and what the sample leaves open is decided on the strings themselves:

0. A text that an earlier document has whole goes whole, and takes no part in the rest.
1. Anchors. Of every ``REACH`` neighbouring positions the one whose ``ANCHOR`` bytes hash lowest is an
   anchor (the leftmost of equal ones), about one position in 25. A string of ``LENGTH`` bytes
   has exactly one window of ``REACH`` such positions, so equal strings have their anchor at the same place
   in them. The strings with one anchor start side by side: a cell.
2. Prefix doubling. Spark sorts the anchors by the hash of their ``ANCHOR`` bytes and then by
   position; an anchor's rank is where its class begins. Anchors that are alone go: no string with
   them repeats. Then the ranks of an anchor and of the 5 anchors that follow are sorted together, which ranks runs of 6
   anchors in one sort; nearly all of these reach past a string of the next anchor, so a further sort would find little.
   Runs that are alone go. A run that is not the first of its class marks all strings inside it. This settles
   the inside of long repeats with one row per anchor.
3. The rest. Cells with strings still unmarked are sorted by rank; one that is alone in its rank is
   dropped. The strings of the others are cut from the texts in blocks of up to ``SIDE`` neighbours.
   Blocks are ranked in the same way, by the bytes that all their strings share and then as a whole, and
   only blocks that are neither alone nor an earlier one over again are taken apart into strings, which are
   ranked at last. The first occurrence of a string is never in a run or block that came second, so it is always there
   to mark the others.
4. Marked strings become spans of bytes per document, and each text is cut in one pass.

Sorting by position as well deals a string that fills a third of the corpus over many tasks; the
classes that lie across their borders, at most two per task, are matched on the driver. Anchors of one
document are dealt out by blocks of ``BLOCK`` bytes; a run may not cross a block, which only leaves
more to step 3. Strings are compared by 128 bits of multilinear hashing with fixed random factors.

Defined cases: a null text is empty and a text shorter than ``LENGTH`` loses nothing; documents
without an id come before all others; rows that share an id follow each other by a hash of their text, and of
rows equal in id and text one counts as first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ensure_columns, staged, text_or_empty

LENGTH = 100
ANCHOR = 52
REACH = LENGTH - ANCHOR + 1  # not more than ANCHOR, so that neighbouring anchors leave no byte between them
DOUBLINGS = (6,)  # by how much runs grow from sort to sort
BLOCK = 1 << 20
SIDE = 16  # strings that are compared as one before they are compared one by one
SAMPLED = 100  # anchors per task that balance the first sort
PIECE = 1 << 20  # positions that are hashed at a time

_rng = np.random.Generator(np.random.PCG64(1215))
_STEP = int(_rng.integers(1, 2**63)) * 2 + 1
_STEP_BACK = pow(_STEP, -1, 2**64)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(0, 2**63, (4, LENGTH // 4 + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + LENGTH, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _order_hash(raw: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from every position, to choose anchors by."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * _powers(_STEP)[: len(raw)], out=sums[1:])
    n = len(raw) - width + 1
    x = (sums[width:] - sums[:n]) * _powers(_STEP_BACK)[:n]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _string_hash(raw: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the ``width`` bytes from each of ``starts``: four multilinear sums of their 32-bit words."""
    sums = np.zeros((4, len(starts)), dtype=np.uint64)
    words = np.lib.stride_tricks.sliding_window_view(raw, 4)
    for k in range(width // 4):
        word = words[starts + 4 * k].copy().view("<u4")[:, 0].astype(np.uint64)
        for row in range(4):
            sums[row] += _FACTORS[row, k] * word
    sums >>= np.uint64(32)
    return tuple((sums[k] << np.uint64(32) | sums[k + 1]).view(np.int64) for k in (0, 2))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in every window of ``width``."""
    n = len(values) - width + 1
    at = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at[:n]


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that stand one after the other, and the first and last start of each one's strings.

    ``ends`` has the end of every text; a string that runs beyond one is none.
    """
    found: list[tuple[np.ndarray, ...]] = []
    total = len(raw) - LENGTH + 1
    for start in range(0, total, PIECE):
        count = min(PIECE, total - start)
        whole = np.ones(count, dtype=bool)
        near = ends[np.searchsorted(ends, start) : np.searchsorted(ends, start + count + LENGTH)]
        beyond = (near[:, None] - start - np.arange(1, LENGTH)).ravel()
        whole[beyond[(beyond >= 0) & (beyond < count)]] = False
        at = _least(_order_hash(raw[start : start + count + LENGTH - 1], ANCHOR), REACH)
        first = np.flatnonzero(whole & np.concatenate(([True], (at[1:] != at[:-1]) | ~whole[:-1])))
        last = np.flatnonzero(whole & np.concatenate(((at[1:] != at[:-1]) | ~whole[1:], [True])))
        found.append((at[first] + start, first + start, last + start))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    place, lo, hi = (np.concatenate(f) for f in zip(*found, strict=True))
    # a cell that was cut where one piece ends and the next begins
    same = np.flatnonzero(place[1:] == place[:-1])
    hi[same] = hi[same + 1]
    keep = np.ones(len(place), dtype=bool)
    keep[same + 1] = False
    return place[keep], lo[keep], hi[keep]


def _joined_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch one after the other, and where each begins and the last ends."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def _record(columns: Sequence, names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], list(names))


def _longs(names: Sequence[str]) -> str:
    return ", ".join(f"{n} long" for n in names)


def _documents(docs: DataFrame) -> DataFrame:
    """Rows ``doc, tie, doc_id, text, copies`` with a key ``doc, tie`` of their own.

    The id alone is the key where none repeats; else rows equal in id and text are one, and a hash of
    the text tells those of one id apart.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"),
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"),
    )
    one = F.lit(1).cast("long").alias("copies")
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("tie"), "doc_id", "text", one)
    keyed = rows.withColumns({"tie": F.xxhash64("text"), "digest": F.sha2(F.col("text").cast("binary"), 256)})
    each = keyed.groupBy("doc", "tie", "digest").agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")
    )
    return staged(each.drop("digest"), "suffix-documents")


_PLACE = ["doc", "tie", "at"]


def _anchor_rows(texts: DataFrame, bounds: list[tuple[int, ...]]) -> DataFrame:
    """Rows ``k1, k2, doc, tie, at, shape, task``: an anchor, its hash, its cell and next anchor packed by distance.

    ``task`` counts the ``bounds`` up to the row's hash and position.
    """
    names = ["k1", "k2", *_PLACE, "shape", "task"]
    first = np.array([b[0] for b in bounds], dtype=np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _joined_texts(batch.column(2))
            place, lo, hi = anchors(raw, offsets[1:])
            if not len(place):
                continue
            row = np.searchsorted(offsets, place, side="right") - 1
            at = place - offsets[row]
            gap = np.append(np.diff(place), 0)
            gap[:-1][(row[1:] != row[:-1]) | (at[1:] // BLOCK != at[:-1] // BLOCK)] = 0
            shape = (place - lo) | (place - hi) << 8 | gap << 16
            k1, k2 = _string_hash(raw, place, ANCHOR)
            doc, tie = (batch.column(k).to_numpy()[row] for k in (0, 1))
            task = np.searchsorted(first, k1, side="right")
            for i in np.flatnonzero(np.isin(k1, first)).tolist():  # the whole place decides
                task[i] = bisect_right(bounds, tuple(int(c[i]) for c in (k1, k2, doc, tie, at)))
            yield _record((k1, k2, doc, tie, at, shape, task.astype(np.int32)), names)

    return texts.select("doc", "tie", "text").mapInArrow(emit, f"{_longs(names[:-1])}, task int")


def _bounds(texts: DataFrame, parts: int) -> list[tuple[int, ...]]:
    """Where to cut the anchors into ``parts`` tasks, from a sample of about a hundred for each.

    Only the sizes of tasks depend on it. Spark's own sample would hash all texts once more.
    """
    share = max(1, texts.count() // (SAMPLED * parts))
    some = texts.where(F.pmod(F.xxhash64("doc", "tie"), F.lit(share)) == 0)
    rows = _anchor_rows(some, []).where(F.pmod(F.xxhash64("doc", "tie", "at"), F.lit(SAMPLED)) == 0)
    found = sorted(tuple(r) for r in rows.select("k1", "k2", *_PLACE).limit(4 * SAMPLED * parts).collect())
    return [found[len(found) * k // parts] for k in range(1, parts)] if len(found) > parts else []


def ranked(
    rows: DataFrame, keys: Sequence[str], carried: Sequence[str], keep_alone: bool = False, dealt_by: str | None = None
) -> DataFrame:
    """Rows whose ``keys`` are not alone, or all: ``doc, tie, at, carried.., rank, later``; keys and places are longs.

    Spark sorts by key and position over all tasks. A rank is the number of the task and the row where
    a class begins, so it grows with the key; ``later`` is false for the first position of a class only.
    A task knows no neighbour, so it keeps its first and last row whatever they are, and these
    alone with their keys; classes that go on over a border are put together from them. ``dealt_by`` names the
    task of a row where the caller has dealt rows by key and position already.
    """
    types = dict(rows.dtypes)
    order = [*keys, *_PLACE]
    passed = [*_PLACE, *carried]
    names = [*passed, "rank", "part", *keys, "later", "alone"]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.Table | None = None  # the last row read, whose class may go on
        before: np.ndarray | None = None  # the key in front of it
        number = began = 0

        def solve(table: pa.Table, count: int, last: bool) -> pa.RecordBatch:
            """Rows for the first ``count`` of ``table``, behind which one more stands unless they are the last."""
            nonlocal before, number, began
            key = np.stack([table[k].to_numpy() for k in keys])
            opens = np.ones(key.shape[1] + 1, dtype=bool)
            opens[1:-1] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            if before is not None:
                opens[0] = bool((key[:, 0] != before).any())
            alone = opens[:count] & opens[1 : count + 1]
            opens = opens[:count]
            place = number + np.arange(count)
            start = np.maximum.accumulate(np.where(opens, place, began))
            at_border = place == 0
            at_border[-1] |= last
            keep = ~alone | at_border | keep_alone
            before, number, began = key[:, count - 1], number + count, int(start[-1])
            kept = table.slice(0, count).filter(pa.array(keep))
            inner = ~at_border[keep]
            return _record(
                [
                    *[kept[c].combine_chunks() for c in passed],
                    (np.int64(part) << np.int64(38)) + start[keep],
                    np.full(len(inner), part, dtype=np.int64),
                    *[pa.array(kept[k].to_numpy(), mask=inner) for k in keys],
                    ~opens[keep], alone[keep],
                ],
                names,
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if table.num_rows > 1:
                yield solve(table, table.num_rows - 1, False)
            held = table.slice(table.num_rows - 1)
        if held is not None:
            yield solve(held, 1, True)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if dealt_by is None:
        dealt = rows.select(*keys, *passed).repartitionByRange(parts, *order)
    else:
        dealt = rows.repartitionById(parts, dealt_by).select(*keys, *passed)
    schema = f"{', '.join(f'{c} {types[c]}' for c in passed)}, {_longs(['rank', 'part', *keys])}, later boolean, alone boolean"
    found = staged(dealt.sortWithinPartitions(*order).mapInArrow(rank, schema), "suffix-ranks")
    borders = found.where(F.col(keys[0]).isNotNull()).select("part", "rank", *keys).orderBy("part", "rank").collect()
    joined: list[tuple[int, int]] = []
    for i, (one, two) in enumerate(zip(borders, borders[1:], strict=False)):
        if one["part"] != two["part"] and all(one[k] == two[k] for k in keys):
            # the class of ``one`` may itself have come over a border, as the only class of its task
            origin = joined[-1][1] if joined and joined[-1][0] == one["rank"] else one["rank"]
            if origin == one["rank"]:
                joined.append((origin, origin))
            joined.append((two["rank"], origin))
    if not joined:
        return (found if keep_alone else found.where("not alone")).select(*passed, "rank", "later")
    # at most two rows per task
    moved = rows.sparkSession.createDataFrame(joined, "rank long, origin long").distinct()
    whole = found.join(F.broadcast(moved), "rank", "left")
    if not keep_alone:
        whole = whole.where("origin is not null or not alone")
    later = F.col("later") | F.coalesce(F.col("origin") != F.col("rank"), F.lit(False))
    return whole.select(*passed, F.coalesce("origin", "rank").alias("rank"), later.alias("later"))


def _grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole groups, with the number of each row's group."""
    held: list[pa.Table] = []

    def whole() -> tuple[pa.Table, np.ndarray]:
        table = pa.concat_tables(held)
        fresh = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            column = table[k].to_numpy()
            fresh[1:] |= column[1:] != column[:-1]
        return table, np.cumsum(fresh)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        other = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            column = table[k].to_numpy()
            other |= column != column[-1]
        begins = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # of the group that may go on
        if held and any(held[-1][k][-1].as_py() != table[k][0].as_py() for k in keys):
            yield whole()
            held = []
        if begins:
            held.append(table.slice(0, begins))
            yield whole()
            held = []
        held.append(table.slice(begins))
    if held:
        yield whole()


_IN_BLOCK = ["doc", "tie", "block"]
_STRIDE = 4 * BLOCK


def _chains(runs: DataFrame, many: int) -> DataFrame:
    """Rows ``doc, tie, at, end, nxt, k1.., gaps``: every short run with the ``many - 1`` that follow, if all are in ``runs``."""
    keys = [f"k{k + 1}" for k in range(many)]
    names = [*_PLACE, "end", "nxt", *keys, "gaps"]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _grouped(batches, _IN_BLOCK):
            doc, tie, at, end, nxt, rank, block = (
                table[c].to_numpy() for c in (*_PLACE, "end", "nxt", "rank", "block")
            )
            shift = group * _STRIDE - block * BLOCK
            places = at + shift
            follows = np.minimum(np.searchsorted(places, nxt + shift), len(at) - 1)
            met = (nxt >= 0) & (places[follows] == nxt + shift)
            # a run past the last string of the next anchor is long enough
            first = np.flatnonzero(end < at + LENGTH + REACH)
            last, ranks, gaps = first, [rank[first]], np.zeros(len(first), dtype=np.int64)
            for _ in range(many - 1):
                on = met[last]
                first, last, gaps, ranks = first[on], last[on], gaps[on], [r[on] for r in ranks]
                onward = follows[last]
                gaps = gaps << np.int64(64 // many) | (at[onward] - at[last])
                last = onward
                ranks.append(rank[last])
            yield _record((doc[first], tie[first], at[first], end[last], nxt[last], *ranks, gaps), names)

    dealt = runs.withColumn("block", F.floor(F.col("at") / BLOCK)).repartition(*_IN_BLOCK)
    ordered = dealt.sortWithinPartitions(*_IN_BLOCK, "at").select(*_PLACE, "end", "nxt", "rank", "block")
    return ordered.mapInArrow(chain, _longs(names))


def _copies(texts: DataFrame) -> DataFrame:
    """Rows ``doc, tie, lo, hi`` of the texts that an earlier document has whole: they go whole."""
    digest = F.md5(F.col("text").cast("binary"))
    halves = [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(k) for k, at in (("k1", 1), ("k2", 17))]
    zero = F.lit(0).cast("long")
    long_enough = texts.select(*halves, "doc", "tie", zero.alias("at"), F.octet_length("text").cast("long").alias("hi"))
    same = ranked(long_enough.where(F.col("hi") >= LENGTH), ["k1", "k2"], ["hi"]).where("later")
    return staged(same.select("doc", "tie", zero.alias("lo"), "hi"), "suffix-copies")


def _runs(cells: DataFrame) -> list[DataFrame]:
    """Rows ``doc, tie, at, end, nxt, rank, later`` of runs of anchors that are not alone, for each of ``DOUBLINGS``."""
    runs = cells.select(
        *_PLACE, (F.col("at") + ANCHOR).alias("end"),
        F.when(F.col("gap") > 0, F.col("at") + F.col("gap")).otherwise(-1).cast("long").alias("nxt"), "rank",
    )
    out = []
    for many in DOUBLINGS:
        keys = [*(f"k{k + 1}" for k in range(many)), "gaps"]
        runs = ranked(_chains(runs, many), keys, ["end", "nxt"])
        out.append(runs)
    return out


def _open_cells(cells: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """What runs mark and what they leave: rows ``doc, tie, at, rank, lo, hi``.

    With a null rank: bytes ``[lo, hi)`` of a document that go. Else: a cell and its strings that no run has marked.
    """
    marks = [
        r.where("later").where(F.col("end") - F.col("at") >= LENGTH)
        .select("doc", "tie", "at", F.lit(-1).cast("long").alias("rank"), F.col("at").alias("lo"), (F.col("end") - LENGTH).alias("hi"))
        for r in runs
    ]
    strings = cells.select(*_PLACE, "rank", "lo", "hi")
    both = reduce(DataFrame.unionByName, marks, strings).withColumn("block", F.floor(F.col("lo") / BLOCK))
    names = [*_PLACE, "rank", "lo", "hi"]

    def solve(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        doc, tie, block, lo, hi, at, rank = (table[c].to_numpy() for c in ("doc", "tie", "block", "lo", "hi", "at", "rank"))
        shift = group * _STRIDE - block * BLOCK
        a, b = lo + shift, hi + shift
        is_mark = rank < 0
        marked = np.flatnonzero(is_mark)
        furthest = np.maximum.accumulate(b[marked]) if len(marked) else b[marked]
        begins = np.ones(len(marked), dtype=bool)
        begins[1:] = a[marked][1:] > furthest[:-1] + 1
        first = marked[begins]
        starts, stops = a[first], furthest[np.append(np.flatnonzero(begins)[1:] - 1, len(marked) - 1)] if len(marked) else a[first]
        # strings at either end of a cell that lie among the marked ones
        cell = np.flatnonzero(~is_mark)
        x, y = a[cell], b[cell]
        if len(starts):
            i = np.searchsorted(starts, x, side="right") - 1
            x = np.where((i >= 0) & (stops[i] >= x), stops[i] + 1, x)
            j = np.searchsorted(starts, y, side="right") - 1
            y = np.where((j >= 0) & (stops[j] >= y), starts[j] - 1, y)
        left = x <= y
        cell, x, y = cell[left], x[left], y[left]
        return _record(
            [
                *[np.concatenate((c[first], c[cell])) for c in (doc, tie, at)],
                pa.array(np.concatenate((rank[first], rank[cell])), mask=np.arange(len(first) + len(cell)) < len(first)),
                np.concatenate((starts - shift[first], x - shift[cell])),
                np.concatenate((stops - shift[first] + LENGTH, y - shift[cell])),
            ],
            names,
        )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _grouped(batches, _IN_BLOCK):
            yield solve(table, group)

    dealt = both.repartition(*_IN_BLOCK).sortWithinPartitions(*_IN_BLOCK, "lo")
    return dealt.select("block", *names).mapInArrow(sweep, _longs(names))


def _blocks(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows ``k1, k2, doc, tie, at, body``: up to ``SIDE`` strings of a cell that start side by side from ``at``.

    ``body`` holds their bytes, ``k1, k2`` hash those that all strings so far from the anchor share. So
    equal strings are in blocks of equal hashes.
    """
    names = ["k1", "k2", *_PLACE, "body"]
    core = (LENGTH - SIDE + 1) // 4 * 4

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _joined_texts(batch.column(2))
            cell = batch.column(3)
            row = np.repeat(np.arange(len(batch)), np.diff(cell.offsets.to_numpy()))
            anchor, lo, hi = (cell.flatten().field(c).to_numpy() for c in ("at", "lo", "hi"))
            doc, tie = (batch.column(k).to_numpy() for k in (0, 1))
            near, far = (anchor - hi) // SIDE, (anchor - lo) // SIDE
            counts = far - near + 1
            each = np.repeat(np.arange(len(row)), counts)
            line = near[each] + np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = np.maximum(lo[each], anchor[each] - line * SIDE - SIDE + 1)
            end = np.minimum(hi[each], anchor[each] - line * SIDE) + LENGTH
            shift = offsets[row[each]]
            for start in range(0, len(each), PIECE // 8):
                part = slice(start, start + PIECE // 8)
                k1, k2 = _string_hash(raw, (anchor[each] - line * SIDE + shift)[part], core)
                sizes = (end - begin)[part]
                stops = np.cumsum(sizes)
                at = np.arange(stops[-1]) + np.repeat((begin + shift)[part] - stops + sizes, sizes)
                body = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, stops).astype(np.int64)), pa.py_buffer(raw[at])]
                ).cast(pa.binary())
                own = row[each[part]]
                yield _record((k1, k2, doc[own], tie[own], begin[part], body), names)

    listed = cells.groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("cells"))
    joined = texts.select("doc", "tie", "text").join(listed, ["doc", "tie"])
    return joined.select("doc", "tie", "text", "cells").mapInArrow(emit, f"{_longs(names[:-1])}, body binary")


def _strings(blocks: DataFrame) -> DataFrame:
    """Rows ``k1, k2, doc, tie, at``: the strings of blocks with their hashes."""
    names = ["k1", "k2", *_PLACE]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(3).cast(pa.large_binary())
            offsets = np.frombuffer(bodies.buffers()[1], dtype=np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
            if not len(bodies):
                continue
            raw = np.frombuffer(bodies.buffers()[2], dtype=np.uint8)
            counts = np.diff(offsets) - LENGTH + 1
            row = np.repeat(np.arange(len(bodies)), counts)
            step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            k1, k2 = _string_hash(raw, offsets[:-1][row] + step, LENGTH)
            doc, tie, at = (batch.column(k).to_numpy()[row] for k in range(3))
            yield _record((k1, k2, doc, tie, at + step), names)

    return blocks.select(*_PLACE, "body").mapInArrow(emit, _longs(names))


def _late_strings(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows ``doc, tie, lo, hi``: bytes of strings in ``cells`` that also start earlier."""
    shared = ranked(_blocks(texts, cells), ["k1", "k2"], ["body"])
    whole = shared.select(
        F.col("rank").alias("k1"), F.xxhash64("body").alias("k2"), F.xxhash64(F.lit(1), "body").alias("k3"),
        *_PLACE, "body", F.col("rank").alias("core"),
    )
    # a block that is an earlier one over again goes at once; the first of its kind is taken apart only
    # if others share its core
    judged = ranked(whole, ["k1", "k2", "k3"], ["body", "core"], keep_alone=True)
    firsts = judged.where("not later").select(F.col("core").alias("k1"), *_PLACE, "body")
    mixed = ranked(firsts, ["k1"], ["body"])
    late = ranked(_strings(mixed), ["k1", "k2"], []).where("later")
    size = F.octet_length("body").cast("long")
    return judged.where("later").select("doc", "tie", F.col("at").alias("lo"), (F.col("at") + size).alias("hi")).unionByName(
        late.select("doc", "tie", F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi"))
    )


def _cut(texts: DataFrame, spans: DataFrame, with_bytes: bool) -> DataFrame:
    """Every document without its spans."""
    schema = "doc_id long, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                raw = text.as_buffer().to_pybytes()
                gone = count = 0
                if found.is_valid:
                    los, his = (found.values.field(c).to_numpy() for c in ("lo", "hi"))
                    order = np.argsort(los, kind="stable")
                    los, furthest = los[order], np.maximum.accumulate(his[order])
                    begins = np.flatnonzero(np.concatenate(([True], los[1:] > furthest[:-1])))
                    starts, stops = los[begins], furthest[np.append(begins[1:] - 1, len(los) - 1)]
                    gone, count = int((stops - starts).sum()), len(starts)
                    edges = zip([0, *stops.tolist()], [*starts.tolist(), len(raw)], strict=True)
                    kept = b"".join(raw[x:y] for x, y in edges)
                else:
                    kept = raw
                out.append((len(raw), gone, count, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield _record(
                [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names
            )

    listed = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = texts.join(listed, ["doc", "tie"], "left").select("doc_id", "copies", "text", "spans")
    return joined.mapInArrow(cut, schema)


def _with_copies(rows: DataFrame) -> DataFrame:
    """Rows for all copies: the first as it is, the others gone whole if they are long enough."""
    pages = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK))
    size = F.least(F.lit(BLOCK).cast("long"), F.col("copies") - F.col("page") * BLOCK)
    each = rows.withColumn("page", F.explode(pages)).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), size))
    )
    gone = ((F.col("page") > 0) | (F.col("copy") > 1)) & (F.col("n_bytes") >= LENGTH)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return each.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(gone, empty).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(gone, F.when(F.col("kept").isNotNull(), F.lit(b""))).otherwise(F.col("kept")).alias("kept"),
    )


def remove_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (null unless ``with_bytes``)."""
    ensure_columns(docs, "doc_id", "text")
    everything = _documents(docs)
    copies = _copies(everything)
    texts = everything.join(copies.select("doc", "tie"), ["doc", "tie"], "left_anti")
    shape = F.col("shape")

    def unpacked(by: int, name: str):
        return F.shiftright(shape, by).bitwiseAND(F.lit(255)).alias(name)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _anchor_rows(texts, _bounds(texts, parts))
    cells = ranked(placed, ["k1", "k2"], ["shape"], dealt_by="task").select(
        *_PLACE, "rank", (F.col("at") - unpacked(0, "lo")).alias("lo"), (F.col("at") - unpacked(8, "hi")).alias("hi"),
        unpacked(16, "gap"),
    )
    swept = staged(_open_cells(cells, _runs(cells)), "suffix-swept")
    open_cells = swept.where("rank is not null").select(*_PLACE, F.col("rank").alias("k1"), "lo", "hi")
    late = _late_strings(texts, ranked(open_cells, ["k1"], ["lo", "hi"]))
    spans = reduce(DataFrame.unionByName, [swept.where("rank is null").select("doc", "tie", "lo", "hi"), late], copies)
    return _with_copies(_cut(everything, spans, with_bytes))
