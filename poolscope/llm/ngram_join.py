"""N-gram Jaccard join by prefix trees, and the classes it makes.

A document's set is its distinct word shingles as 64-bit hashes. Two documents link when their
Jaccard similarity reaches the threshold; a class is what links connect.

1. Equal sets are found by a digest and stand for one set from here on. Of each set the first shingles by hash are
   looked up, a few more than the prefix in which linking sets must share one: so linking sets share several of
   them. A set that holds fewer shingles there that any other set has there too links with nothing and takes no further part.
2. Dealing. If two sets link, at most D of their shingles differ, with D a fixed share of their
   sizes. So if hashes are dealt into D + 1 ranges, some range holds the same shingles in both sets
   (pigeonhole; some ranges more keep empty ones out of play). Every set emits one signature per
   range, for its own class of sizes and the next larger one; sets that share a signature get connected through the smallest id of the signature,
   which is linear in the rows. Signatures are combined within each task before the shuffle, so a
   signature that a third of all documents share arrives as one row per task.
   A block above ``BLOCK`` sets is cut by prefix filtering: with shingles ordered by rarity in the block, linking
   sets share one of their first few, so sets meet only through these.
3. Trie join. The sets connected in this way meet in one block. Their shingles are ordered by
   frequency in the block, then by hash; the sets go into a prefix tree in that order. Each set
   traverses the tree and shares the overlap of a path with all sets below it. A subtree is left
   when the shingles that remain on either side cannot reach the threshold, when all its sets
   already belong to the probing set's class, or when all of them come before it and so have met it. Where
   many nodes are left to visit, they are visited together. What comes out is a spanning forest of the links.
4. A block above ``BLOCK`` sets is split into parts by hash. Every part also takes about
   ``PIVOTS`` pivots of the block, which tie the classes of its parts together. Where parts still
   hold several classes, the sets outside the block's largest class are dealt into as few parts as
   they fill, and each of these meets each part of the block: its sets are looked up in the tree of that part's.
   So a group of copies of any size is joined in bounded parts, and no link between different sets is lost.

Hashes are 64 bits wide; a collision matters only between the shingles of two sets that meet.

Defined cases: a null or empty text has no set, no links and is a class of its own; every row is
returned, repeated ones too, each with the class of its own set; a null id links with nothing and
has a null class unless its set equals that of a row with an id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import WORD, ensure_columns, released, staged

WIDTH = 3
PERCENT = 90
BLOCK = 1024
PIVOTS = 8
HELD = 2_000_000  # signatures that a task combines at a time
SHARED = 16  # shingles of their prefixes that linking sets share at least, if they have as many
WIDE = 6  # nodes of a tree that are worth a step of their own together
ORDERED = (64, 30)  # the same for the prefixes that large blocks order by rarity, and in percent of a set
SCREEN = (32, 2**26)  # bits of a screen for each of its keys, and at most
MAP = 2**15  # Fixed value: bits of one bitmap of Spark's ``bitmap_construct_agg``

_rng = np.random.Generator(np.random.PCG64(20260))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a shorter text is one shingle."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    blank = _SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    # polynomial hash of each word from its first byte, independent of what stands before it
    raw, blank, lead = raw[starts[0] :], blank[starts[0] :], starts[0]
    starts, ends = starts - lead, ends - lead
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    longest = int((ends - starts).max())
    valued = np.where(blank, np.uint64(0), _BYTE[_LOWER[raw]] * _powers(longest)[np.minimum(place, longest - 1)])
    words = _mix(np.add.reduceat(valued, starts) + (ends - starts).astype(np.uint64))
    n = max(1, len(words) - width + 1)
    found = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(words))):
        found = _mix(found * _BASE + words[k : k + n])
    return np.unique(found)


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _size_edges(percent: int, up_to: int = 2**31) -> np.ndarray:
    """Smallest sizes of the classes: linking sets are in one class or in neighbouring ones."""
    edges = [1]
    while edges[-1] < up_to:
        edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent))
    return np.array(edges, dtype=np.int64)


def signatures(shingles: np.ndarray, percent: int, edges: np.ndarray) -> np.ndarray:
    """One 64-bit signature per hash range, for the set's size class and the next larger one."""
    n = len(shingles)
    own = int(np.searchsorted(edges, n, side="right")) - 1
    out = []
    for group in (own, own + 1):
        if group + 1 >= len(edges):
            continue
        largest = int(edges[group + 1]) - 1
        # |A| + |B| - 2 |A and B| with |A and B| >= percent / (100 + percent) * (|A| + |B|)
        differ = 2 * largest * (100 - percent) // (100 + percent)
        spare = 1 + differ // 50
        ranges = differ + 1 + spare
        dealt = ((shingles >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(dealt, prepend=np.uint64(2**63)))
        sums = np.zeros(ranges, dtype=np.uint64)
        sums[dealt[first].astype(np.int64)] = np.add.reduceat(_mix(shingles), first)
        # more than ``spare`` ranges agree, so empty ones need a signature only if there are as many
        which = dealt[first].astype(np.int64) if ranges - len(first) <= spare else np.arange(ranges)
        salt = (group * 0xD6E8FEB86659FD93 + 1) % 2**64
        out.append(_mix(sums[which] + _mix(which.astype(np.uint64) * _BASE + np.uint64(salt))))
    return np.concatenate(out)


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


class _Node:
    __slots__ = ("segment", "depth", "children", "members")

    def __init__(self, segment: np.ndarray, depth: int):
        self.segment, self.depth = segment, depth
        self.children: list[_Node] = []
        self.members: list[int] = []


def _build(order: list[int], sets: list[np.ndarray]) -> _Node:
    """A prefix tree with merged single paths, over sets in lexicographic order."""
    root = _Node(np.empty(0, dtype=np.int64), 0)
    path = [root]
    before = np.empty(0, dtype=np.int64)
    for i in order:
        own = sets[i]
        m = min(len(own), len(before))
        unequal = np.flatnonzero(own[:m] != before[:m])
        shared = int(unequal[0]) if len(unequal) else m
        while path[-1].depth > shared:
            node = path.pop()
            start = node.depth - len(node.segment)
            if start < shared:
                upper = _Node(node.segment[: shared - start], shared)
                node.segment = node.segment[shared - start :]
                upper.children.append(node)
                path[-1].children[-1] = upper
                path.append(upper)
        if len(own) > shared:
            leaf = _Node(own[shared:], len(own))
            path[-1].children.append(leaf)
            path.append(leaf)
        path[-1].members.append(i)
        before = own
    return root


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start up to its stop, one range after the other, and how many each has."""
    counts = stops - starts
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts), counts


class _Tree:
    """A prefix tree as arrays, its nodes level by level, so that the children of a node stand side by side.

    ``first`` and ``last`` are the places, in lexicographic order, of the sets below a node; ``least`` and ``most`` their sizes.
    """

    def __init__(self, root: _Node, place: np.ndarray, sizes: np.ndarray):
        nodes, children, members = [root], [1], [0]
        for node in nodes:
            nodes.extend(node.children)
            children.append(len(nodes))
            members.append(members[-1] + len(node.members))
        self.children, self.ends = np.array(children[:-1]), np.array(children[1:])
        self.own, self.own_ends = np.array(members[:-1]), np.array(members[1:])
        self.members = np.array([i for node in nodes for i in node.members], dtype=np.int64)
        stops = np.cumsum([len(node.segment) for node in nodes])
        self.starts, self.stops = np.append(0, stops[:-1]), stops
        self.segments = np.concatenate([node.segment for node in nodes])
        self.depth = np.array([node.depth for node in nodes])
        n = len(nodes)
        bounds = [[0] * n for _ in range(4)]
        first, last, least, most = bounds
        for k in range(n - 1, -1, -1):
            of, below = nodes[k].members, range(children[k], children[k + 1])
            first[k] = min([*(int(place[i]) for i in of), *(first[c] for c in below)], default=0)
            last[k] = max([*(int(place[i]) for i in of), *(last[c] for c in below)], default=-1)
            least[k] = min([*(int(sizes[i]) for i in of), *(least[c] for c in below)], default=0)
            most[k] = max([*(int(sizes[i]) for i in of), *(most[c] for c in below)], default=0)
        self.first, self.last, self.least, self.most = (np.array(b, dtype=np.int64) for b in bounds)
        columns = (self.depth, self.starts, self.stops, self.own, self.own_ends, self.children, self.ends)
        self.rows = list(zip(*bounds, *(c.tolist() for c in columns), strict=True))


def trie_links(
    shingles: list[np.ndarray], percent: int = PERCENT, known: list | None = None, probing: list[bool] | None = None
) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, as pairs of positions.

    ``known`` names a class for each set; sets of one class count as connected already. With ``probing``, only links
    between a set that has it and one that has not are sought; else each two sets are compared once at most.
    """
    m = len(shingles)
    label = np.arange(m)
    if known is not None:
        first: dict = {}
        label = np.array([first.setdefault(k, i) for i, k in enumerate(known)], dtype=np.int64)
    every, counts = np.unique(np.concatenate(shingles), return_counts=True)
    rank = np.empty(len(every), dtype=np.int64)
    rank[np.lexsort((every, -counts))] = np.arange(len(every))
    sets = [np.sort(rank[np.searchsorted(every, s)]) for s in shingles]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = sorted(range(m), key=lambda i: sets[i].astype(">i8").tobytes())
    held = order if probing is None else [i for i in order if not probing[i]]
    place = np.full(m, -1)
    place[held] = np.arange(len(held))
    if not held:
        return []
    tree = _Tree(_build(held, sets), place, sizes)
    has = np.zeros(len(every), dtype=bool)
    links: list[tuple[int, int]] = []
    runs: np.ndarray | None = None

    def join(x: int, y: int) -> None:
        nonlocal runs
        if label[y] != label[x]:
            label[label == label[y]] = label[x]
            links.append((x, y))
            runs = None

    def narrow(x: int, own: np.ndarray, nodes: list[int], overlaps: list[int]) -> None:
        """Replace the last of ``nodes`` by those of its children that may hold links of ``x``."""
        k, overlap, n = nodes.pop(), overlaps.pop(), len(own)
        first, last, least, most, depth, start, stop, member, member_end, child, child_end = tree.rows[k]
        if last <= place[x] or most * 100 < n * percent or n * 100 < least * percent:
            return
        if runs[first] == runs[last] and classes[first] == label[x]:
            return
        if stop > start:
            segment = tree.segments[start:stop]
            overlap += int(np.count_nonzero(has[segment]))
            # what can still match: the rest of x beyond this path, or the rest of the longest set below
            rest = min(n - int(np.searchsorted(own, segment[-1], side="right")), most - depth)
            if (100 + percent) * (overlap + rest) < percent * (n + least):
                return
        for y in tree.members[member:member_end].tolist():
            if place[y] > place[x] and 100 * overlap >= percent * (n + len(sets[y]) - overlap):
                join(x, y)
        nodes.extend(range(child, child_end))
        overlaps.extend([overlap] * (child_end - child))

    def wide(x: int, own: np.ndarray, nodes: np.ndarray, overlap: np.ndarray) -> tuple[list[int], list[int]]:
        """The same for all ``nodes`` at once."""
        n = len(own)
        first, last, least, most = tree.first[nodes], tree.last[nodes], tree.least[nodes], tree.most[nodes]
        near = (last > place[x]) & (most * 100 >= n * percent) & (n * 100 >= least * percent)
        near &= (runs[first] != runs[last]) | (classes[first] != label[x])
        nodes, overlap, least, most = nodes[near], overlap[near], least[near], most[near]
        if not len(nodes):
            return [], []
        steps, lengths = _ranges(tree.starts[nodes], tree.stops[nodes])
        overlap = overlap + np.add.reduceat(has[tree.segments[steps]], np.cumsum(lengths) - lengths, dtype=np.int64)
        rest = n - np.searchsorted(own, tree.segments[tree.stops[nodes] - 1], side="right")
        near = (100 + percent) * (overlap + np.minimum(rest, most - tree.depth[nodes])) >= percent * (n + least)
        nodes, overlap = nodes[near], overlap[near]
        which, counts = _ranges(tree.own[nodes], tree.own_ends[nodes])
        others, shared = tree.members[which], np.repeat(overlap, counts)
        for y in others[(place[others] > place[x]) & (100 * shared >= percent * (n + sizes[others] - shared))].tolist():
            join(x, y)
        below, counts = _ranges(tree.children[nodes], tree.ends[nodes])
        return below.tolist(), np.repeat(overlap, counts).tolist()

    for x in order if probing is None else [i for i in order if probing[i]]:
        own = sets[x]
        has[own] = True
        nodes, overlaps = [0], [0]
        while nodes:
            if runs is None:  # sets that stand next to each other and are of one class share a run
                classes = label[held]
                runs = np.cumsum(np.append(False, classes[1:] != classes[:-1]))
            if len(nodes) < WIDE:
                narrow(x, own, nodes, overlaps)
            else:  # never the root, so all have a segment
                nodes, overlaps = wide(x, own, np.array(nodes), np.array(overlaps))
        has[own] = False
    return links


def _screened(rows: DataFrame, column: str, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` those whose ``column`` may be in the one column of ``listed``, of the same type, and those where it is not.

    The first holds all that are listed and few others. Every task gets a bitmap of the hashed keys, which is bounded however long
    the list is, so the rows need no shuffle to be told apart; a list too long for it leaves more to the first.
    """
    each, most = SCREEN
    bits = MAP
    while bits < min(most, each * listed.count()):
        bits *= 2

    def spot(key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(bits))

    name, taken = "__screen", {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    key = listed.columns[0]
    maps = listed.groupBy(F.floor(spot(key) / MAP).alias("map")).agg(F.bitmap_construct_agg(spot(key) % MAP).alias("bits"))
    maps = maps.select(F.struct("map", "bits").alias(name))
    at = spot(column) % MAP
    byte = F.conv(F.hex(F.substring(F.col(f"{name}.bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.floor(spot(column) / MAP) == F.col(f"{name}.map"), "left")
    may = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return met.where(may).drop(name), met.where(~may).drop(name)


def _among(rows: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` is in ``listed``; few others cross a shuffle, however long the list is."""
    some, _ = _screened(rows, column, listed)
    return some.join(listed.toDF(column), column, "left_semi")


def _without(rows: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` is not in ``listed``, or null; few of them cross a shuffle."""
    some, others = _screened(rows, column, listed)
    return others.unionByName(some.join(listed.toDF(column), column, "left_anti"))


def _set_classes(docs: DataFrame, width: int) -> DataFrame:
    """Per row ``doc_id, n_shingles, digest``."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest"],
            )

    return docs.mapInArrow(released(digests), "doc_id long, n_shingles long, digest binary")


_EDGE = ["a", "b"]


def _combined(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest id, and a spanning forest of the ids that share keys."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    least = np.repeat(ids[first], np.diff(np.append(first, len(ids))))
    loose = least != ids
    pairs = np.unique(np.stack([least[loose], ids[loose]], axis=1), axis=0) if loose.any() else np.empty((0, 2), np.int64)
    nodes, places = np.unique(pairs, return_inverse=True)
    tree, kept = _Sets(len(nodes)), []
    for k, (a, b) in enumerate(places.reshape(-1, 2).tolist()):
        if tree.find(a) != tree.find(b):
            tree.join(a, b)
            kept.append(k)
    forest = pairs[kept]
    return keys[first], ids[first], forest[:, 0], forest[:, 1]


def _demanded(n: int, percent: int, few: int = SHARED, share: int | None = None) -> tuple[int, int]:
    """How many shingles, first by hash, stand for a set of ``n``, and how many of them each set that it links with has among its own.

    ``few`` and ``share`` percent of the set, the larger one, are what linking sets are to share there; half of what they may differ by if not given.

    Linking sets share at least ``least(n)`` shingles. With ``more(n)`` a number that grows with n, the first
    n - least(n) + more(n) of either hold the smaller ``more`` of the two; a set that links has ``least(n)`` shingles or above.
    """

    def least(n: int) -> int:
        return (n * percent + 99) // 100

    def more(n: int) -> int:
        return min(least(n), max(few, n * (100 - percent) // 200 if share is None else n * share // 100))

    # up to ``few`` shingles, a set and all that it links with are looked up whole
    return n - least(n) + more(n), least(n) if n <= few else more(least(n))


def _possible(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Ids of ``texts`` that can link with another: all that do, and some that do not.

    A task counts the shingles that several of its own sets hold, and sends of each of these one row
    without an id. So no shingle has more rows than there are tasks and pieces of tasks. An id with several rows stays.
    """
    names = ["a", "b", "found"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[int] = []
        needed: list[int] = []
        held = 0

        def combined() -> pa.RecordBatch:
            token = np.concatenate(keys)
            row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            order = np.argsort(token, kind="stable")
            token, row = token[order], row[order]
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            counts = np.diff(np.append(first, len(token)))
            several = np.repeat(counts > 1, counts)
            own = np.array(ids, dtype=np.int64)
            here = np.bincount(row[several], minlength=len(own)) - np.array(needed, dtype=np.int64)
            a = np.concatenate((token[first].view(np.int64), own))
            b = np.concatenate((own[row[first]], own))
            nowhere = np.concatenate((counts > 1, np.zeros(len(own), dtype=bool)))
            found = np.concatenate((np.zeros(len(first), dtype=np.int64), here))
            is_token = np.arange(len(a)) < len(first)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=nowhere), pa.array(found, mask=is_token)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shingles = shingle_set(text.as_py(), width)
                if len(shingles):
                    size, need = _demanded(len(shingles), percent)
                    keys.append(shingles[:size])
                    ids.append(doc_id)
                    needed.append(need)
                    held += size
            if held > HELD:
                yield combined()
                keys, ids, needed, held = [], [], [], 0
        if held:
            yield combined()

    rows = texts.where("doc_id is not null").mapInArrow(released(emit), "a long, b long, found long")
    # a row with ``found`` has what a set's own task found, less what it needs; any other row is a shingle
    met = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("a"))).where("b is not null and (n > 1 or found is not null)")
    each = met.groupBy(F.col("b").alias("id")).agg(
        F.sum(F.coalesce("found", F.lit(1))).alias("over"), F.count("found").alias("rows")
    )
    return each.where("over >= 0 or rows > 1").select("id")


def _candidates(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges ``a, b`` that connect all ids which share a signature."""
    edges_of_size = _size_edges(percent)
    names = ["is_signature", "a", "b"]

    def rows(a: np.ndarray, b: np.ndarray, signature: bool) -> pa.RecordBatch:
        columns = [np.full(len(a), signature), a.astype(np.int64), b.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def combined() -> Iterator[pa.RecordBatch]:
            k, i, a, b = _combined(np.concatenate(keys), np.concatenate(ids))
            yield rows(k.view(np.int64), i, True)
            yield rows(a, b, False)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shingles = shingle_set(text.as_py(), width)
                if len(shingles):
                    keys.append(signatures(shingles, percent, edges_of_size))
                    ids.append(np.full(len(keys[-1]), doc_id, dtype=np.int64))
                    held += len(keys[-1])
            if held > HELD:
                yield from combined()
                keys, ids, held = [], [], 0
        if held:
            yield from combined()

    return _tied(texts.where("doc_id is not null").mapInArrow(released(emit), "is_signature boolean, a long, b long"))


def _tied(rows: DataFrame) -> DataFrame:
    """Edges ``a, b``: from the smallest id of every key to its others, and the edges among ``rows`` as they are.

    ``rows`` has ``is_signature, a, b``: a key and an id, or an edge.
    """

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = least = None
        for batch in batches:  # in order of signature and id
            edge = ~np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=bool)
            keys, ids = (batch.column(k).to_numpy() for k in (1, 2))
            passed = (keys[edge], ids[edge])
            keys, ids = keys[~edge], ids[~edge]
            if len(keys):
                if key is not None and keys[0] == key:
                    keys, ids = np.insert(keys, 0, key), np.insert(ids, 0, least)
                _, firsts, a, b = _combined(keys, ids)
                key, least = keys[-1], firsts[-1]
                passed = (np.concatenate((passed[0], a)), np.concatenate((passed[1], b)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in passed], _EDGE)

    dealt = rows.repartition("a").sortWithinPartitions("a", "b")
    return dealt.mapInArrow(released(tie), "a long, b long")


def _refined(texts: DataFrame, classes: DataFrame, blocks: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """``blocks`` (``id, block``) with those above ``block`` sets cut into the parts that can hold links.

    Of each set the first shingles by hash count, as many as hold ``need`` common ones of any two that link. Within a
    block these are ordered by how many sets hold them, rare ones first. Two sets that link share
    at least one among all but the last ``need`` - 1 of either's. So a set whose first ones
    are its own alone has no link and leaves, and the others meet only through a shingle among these. Pages of
    one template, each with words of its own, come apart in this way without ever being compared.

    A block with an id that has several texts stays as it is.
    """
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    inside = staged(blocks.join(sizes.select("block"), "block"), "ngram-large")
    if inside.isEmpty():
        return blocks
    rows = texts.select(F.col("doc_id").alias("id"), "text").join(inside, "id")
    several = rows.groupBy("id", "block").agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y"))
    whole = several.where("x <> y").select("block").distinct()
    large = staged(inside.join(whole, "block", "left_anti"), "ngram-refined")
    if large.isEmpty():
        return blocks

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shingles = shingle_set(text.as_py(), width)
                shingles = shingles[: _demanded(len(shingles), percent, *ORDERED)[0]]
                found.append(_mix(shingles + _mix(np.array([of]).view(np.uint64))))
                ids.append(np.full(len(shingles), doc_id, dtype=np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids))], ["token", "id"]
                )

    held = texts.select(F.col("doc_id").alias("id"), "text").join(large, "id").select("id", "block", "text")
    tokens = held.mapInArrow(released(emit), "token long, id long")
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = tokens.join(common, "token").groupBy("id").agg(
        F.array_sort(F.collect_set(F.struct("n", "token"))).alias("seen")
    )
    few, share = ORDERED
    most = F.floor((F.col("n_shingles") * percent + 99) / 100)
    need = F.least(F.floor((most * percent + 99) / 100), F.greatest(F.lit(few), F.floor(most * share / 100)))
    need = F.when(F.col("n_shingles") <= few, most).otherwise(need)  # as ``_demanded`` has it
    sized = known.join(classes.select(F.col("doc_id").alias("id"), "n_shingles").distinct(), "id")
    own = F.greatest(F.size("seen") - need + 1, F.lit(0)).cast("int")
    prefix = sized.select("id", F.explode(F.slice("seen", F.lit(1), own)).alias("x"))
    edges = _tied(prefix.select(F.lit(True).alias("is_signature"), F.col("x.token").alias("a"), F.col("id").alias("b")))
    cut = components(edges).select("id", F.col("component").alias("block"))
    return staged(blocks.join(large.select("id"), "id", "left_anti").unionByName(cut), "ngram-cut")


def _joined(members: DataFrame, keys: list[str], width: int, percent: int) -> DataFrame:
    """Links between classes inside every group of ``keys``, from rows with ``id, text, known``.

    With a column ``probing``, only links of a row that has it with one that has not.
    """
    meet = "probing" in members.columns

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        current = None

        def solve() -> pa.RecordBatch:
            known = [g[0] for g in group]
            found = trie_links([g[1] for g in group], percent, known, [g[2] for g in group] if meet else None)
            return pa.RecordBatch.from_arrays(
                [pa.array([known[x] for x, _ in found], pa.int64()), pa.array([known[y] for _, y in found], pa.int64())],
                _EDGE,
            )

        n = len(keys)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[: n + 2]]
            for j, text in enumerate(batch.column(n + 2)):
                key = tuple(c[j] for c in columns[:n])
                if key != current:
                    if len(group) > 1:
                        yield solve()
                    group, current = [], key
                group.append((columns[n][j], shingle_set(text.as_py(), width), columns[n + 1][j]))
        if len(group) > 1:
            yield solve()

    rows = members.select(*keys, "id", "known", "probing" if meet else F.lit(False).alias("probing"), "text")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "id").drop("id")
    return dealt.mapInArrow(released(links), "a long, b long")


def _links(sets: DataFrame, blocks: DataFrame, width: int, percent: int, block: int, pivots: int) -> DataFrame:
    """Rows ``id, component`` of all ids with a link: ``sets`` has ``id, text``, ``blocks`` has ``id, block``."""
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / block).cast("int")
    every = F.ceil(F.col("n") / pivots)
    placed = staged(
        blocks.join(sizes, "block").select(
            "id", "block", parts.alias("parts"),
            F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int").alias("part"),
            (F.pmod(F.xxhash64("id"), every) == 0).alias("is_pivot"),
        ),
        "ngram-blocks",
    )
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    # first round: every part with the pivots of its block
    spots = F.explode(F.when(F.col("is_pivot"), others).otherwise(F.array("part")))
    first = placed.select("id", "block", F.col("id").alias("known"), spots.alias("part"))
    found = staged(_joined(first.join(sets, "id"), ["block", "part"], width, percent), "ngram-links")
    large = placed.where(F.col("parts") > 1)
    label = components(found)
    if large.isEmpty():
        return label
    # second round: sets outside the largest class of a block meet the sets of its other parts
    label = staged(label, "ngram-labels")
    known = staged(
        large.join(label, "id", "left")
        .select("id", "block", "part", "parts", F.coalesce("component", "id").alias("known")),
        "ngram-known",
    )
    largest = (
        known.groupBy("block", "known").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("block").agg(F.max(F.struct("n", "known")).alias("top"))
    )
    marked = known.join(largest, "block").withColumn("outside", F.col("known") != F.col("top.known"))
    # those sets are dealt anew, into as few parts as they fill
    groups = marked.where("outside").groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("groups"))
    meeting = marked.join(groups, "block")
    spread = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i")
    theirs = meeting.select("id", "block", "known", F.lit(False).alias("probing"), spread, F.col("part").alias("j"))
    dealt = F.pmod(F.xxhash64("id", F.lit(11)), F.col("groups")).cast("int").alias("i")
    own = (
        meeting.where("outside")
        .select("id", "block", "known", F.lit(True).alias("probing"), dealt, "part", F.explode(others).alias("j"))
        .where("part != j").drop("part")
    )
    pairs = theirs.unionByName(own)
    more = staged(_joined(pairs.join(sets, "id"), ["block", "i", "j"], width, percent), "ngram-more")
    if more.isEmpty():
        return label
    # these links are between classes, so only classes are merged further
    merged = staged(components(more), "ngram-merged")
    tops = merged.select(F.col("id").alias("component"), F.col("component").alias("top"))
    named = label.join(tops, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return named.unionByName(merged.join(label, "id", "left_anti"))


def ngram_components(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK, pivots: int = PIVOTS
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``."""
    ensure_columns(docs, "doc_id", "text")
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    classes = staged(_set_classes(texts, width), "ngram-classes")
    linked = classes.where("doc_id is not null and digest is not null")
    heads = staged(linked.groupBy("digest").agg(F.min("doc_id").alias("id")), "ngram-heads")
    head_ids = heads.select("id").distinct()
    # texts meet the short lists of copies and of possible ids, and most are told from them without a shuffle
    copies = staged(linked.select("doc_id").distinct().join(head_ids, F.col("doc_id") == F.col("id"), "left_anti"), "ngram-copies")
    possible = staged(_possible(_without(texts, "doc_id", copies), width, percent), "ngram-possible")
    texts = staged(_among(texts, "doc_id", possible), "ngram-texts")
    near = components(_candidates(texts, width, percent))
    blocks = staged(near.select("id", F.col("component").alias("block")), "ngram-near")
    blocks = _refined(texts, classes, blocks, width, percent, block)
    rows = texts.withColumnRenamed("doc_id", "id").join(blocks.select("id"), "id")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["id", "text"])
    sets = staged(rows, "ngram-sets")
    label = staged(_links(sets, blocks, width, percent, block, pivots), "ngram-components")
    named = heads.join(label, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    return classes.join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of ``docs`` that come first in their class, with their own columns, whatever their names.

    First is the smallest id, a row without an id only if none of its class has one. Rows with neither id nor words
    are in no class and stay; of rows equal in id and text one stays, the least by its other columns.

    A row is known by a hash of its id and text, drawn anew until no two different ones share it. Texts
    meet the short list of rows to go, not the long one of rows that stay, and all but a few of those that stay
    are told from it without a shuffle.
    """
    ensure_columns(docs, "doc_id", "text")
    key = "__key"
    while key in docs.columns:
        key += "_"
    doc_id = F.col("doc_id").cast("long")
    keys = None
    for seed in range(8):
        hashed = F.xxhash64(F.lit(seed), doc_id, F.col("text"))
        rows = docs.where(doc_id.isNotNull() | F.coalesce(F.col("text").rlike(WORD), F.lit(False))).select(
            hashed.alias("key"), doc_id.alias("doc_id"), F.xxhash64(F.col("text"), doc_id, F.lit(-1 - seed)).alias("other")
        )
        each = rows.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("named"), F.min("other").alias("least"), F.max("other").alias("most")
        )
        keys = staged(each, "ngram-keys")
        if keys.where("least <> most").isEmpty():
            break
    else:
        raise RuntimeError("different rows shared a hash with every seed")
    keyed = docs.withColumn(key, hashed)
    classes = ngram_components(keyed.select(F.col(f"`{key}`").alias("doc_id"), "text"), width, percent)
    listed = classes.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("component"))
    # ids that are missing come after all others
    ranked = listed.join(keys.select("key", "named", "n"), "key").select(
        "key", "n", "component", F.struct(F.col("named").isNull().alias("unnamed"), "named", "key").alias("place")
    )
    ranked = staged(ranked, "ngram-listed")
    first = ranked.groupBy("component").agg(F.min("place").alias("place")).select(F.col("place.key").alias("key"))
    gone = staged(ranked.join(first, "key", "left_anti").select(F.col("key").alias(key)), "ngram-gone")
    repeated = staged(ranked.where("n > 1").join(first, "key", "left_semi").select(F.col("key").alias(key)), "ngram-repeated")
    kept = _without(keyed, key, gone.unionByName(repeated)).drop(key)
    if repeated.isEmpty():
        return kept
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = keyed.join(repeated, key, "left_semi").groupBy(key).agg(F.min(F.struct(*columns)).alias("row"))
    return kept.unionByName(one.select(*[F.col(f"row.`{c}`") for c in docs.columns]))
