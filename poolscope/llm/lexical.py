"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

A document's score is a sum over the query's terms of (term weight) x (impact), the impact being a
whole number that grows with the term's occurrences and falls with the document's length.

1. One pass over the texts counts terms and keeps, per document, the occurrences of the terms that
   some query asks for. The table it writes is the forward index of every document.
2. Its totals give each term's weight. They are one row and one row per query term.
3. Each task turns the documents it reads into segments of about ``SEGMENT`` postings: one list
   per term, sorted by falling impact. A query reads its lists in step, a block of postings at a time,
   and never looks a document up. What has been read of a document is its lower bound; adding
   the last impact read of every list that has not shown it yet gives its upper bound. Reading
   goes on, in the lists that still matter, until no other document can enter the best ``k`` or tie
   with them, and until both bounds of each of these meet, so scores are final and exact.
   The best of earlier segments of a task are the bar for later ones.
4. Every task passes on at most ``k`` rows a query; one window per query ranks them.

A frequent term's list is cut over segments like the documents, so no list is ever in one place.
Queries go through in blocks of about ``QUERY_CHARS`` characters, the only thing that reaches the
driver and every task; each block is one more pass over the texts.

Defined cases: a text that is null or without terms is not counted and never found; rows that share an id
are documents of their own and equal scores among them are ranked in any order; documents without an id come
last among equals; queries that share an id are one query with all their texts (equal ones once),
one without an id included; a query without a term, or whose terms no document holds, has no rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ensure_columns, staged

SEGMENT = 1_000_000
QUERY_CHARS = 16_000_000
BLOCK = 256
LAST = 2**63 - 1  # where a missing id sorts

# The scale of impacts, and how much of a document's length counts against it, in percent.
SCALE, STEP, DAMPING, SLOPE = 1_000_000_000, 1000, 12, 25

# A term is a run of ASCII letters and digits and of bytes beyond ASCII, so of all characters beyond it.
_BLANK = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in order; only A-Z are lower-cased."""
    return (text or "").encode().lower().translate(_BLANK).split()


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Rows ``doc_id, n, terms, counts`` of all documents with a term; ``n`` counts all their terms."""
    schema = "doc_id long, n long, terms array<int>, counts array<long>"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                asked = [(vocabulary[t], n) for t, n in Counter(found).items() if t in vocabulary]
                ids.append(doc_id)
                sizes.append(len(found))
                terms.append([t for t, _ in asked])
                counts.append([n for _, n in asked])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(index, schema)


def weight(holding: int, documents: int) -> int:
    """The weight of a term that ``holding`` of all documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Segment:
    """Impact-sorted lists of some documents, which are numbered by rising id."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), dtype=np.int64)
        number[by_id] = np.arange(len(ids))
        self.ids = ids[by_id]
        doc = np.repeat(number, sizes)
        impact = (SCALE * counts) // (STEP * counts + DAMPING * np.repeat(norms, sizes))
        order = np.lexsort((doc, -impact, terms))
        self.docs, self.impacts = doc[order], impact[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))

    def lists(self, asked: np.ndarray, factors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per asked term that occurs and counts: its documents and what each adds, best first."""
        at = np.searchsorted(self.terms, asked)
        out = []
        for i, term, factor in zip(at.tolist(), asked.tolist(), factors.tolist(), strict=True):
            if i < len(self.terms) and self.terms[i] == term and factor > 0:
                span = slice(self.starts[i], self.ends[i])
                out.append((self.docs[span], factor * self.impacts[span]))
        return out


def nra(
    lists: Sequence[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, bar: int = 1, block: int = BLOCK
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the ``k`` best documents that reach ``bar``, best first, ties by number.

    ``lists`` hold document numbers and positive whole additions in falling order.
    """
    lower = np.zeros(n_docs, dtype=np.int64)
    seen = np.zeros((len(lists), n_docs), dtype=bool)
    read = [0] * len(lists)
    frontier = np.array([added[0] for _, added in lists], dtype=np.int64)
    needed = range(len(lists))
    alive = None  # the documents that may still count, once no unseen one can
    while True:
        for i in needed:
            docs, added = lists[i]
            upto = min(read[i] + block, len(docs))
            now = docs[read[i] : upto]
            lower[now] += added[read[i] : upto]
            seen[i, now] = True
            read[i] = upto
            frontier[i] = added[upto] if upto < len(docs) else 0
        block *= 2
        known = np.flatnonzero(lower) if alive is None else alive
        floor = bar
        if len(known) >= k:
            floor = max(floor, int(np.partition(lower[known], len(known) - k)[len(known) - k]))
        missing = np.where(seen[:, known], 0, frontier[:, None]).sum(axis=0) if len(lists) else 0
        upper = lower[known] + missing
        left = known[upper >= floor]
        if alive is None and int(frontier.sum()) >= floor:
            needed = [i for i in range(len(lists)) if frontier[i] > 0]
            continue  # a document that no list has shown yet could still reach the floor
        alive = left
        open_lists = ~seen[:, alive] & (frontier > 0)[:, None]
        needed = np.flatnonzero(open_lists.any(axis=1)).tolist()
        if not needed:
            best = alive[lower[alive] >= floor]
            best = best[np.lexsort((best, -lower[best]))][:k]
            return best, lower[best]


def _best_of_tasks(
    index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], k: int, documents: int, length: int, segment: int
) -> DataFrame:
    """Rows ``query, doc_id, score``: the best ``k`` of every task for every query."""

    def solve(held: list[pa.RecordBatch], best: list[tuple[np.ndarray, np.ndarray]]) -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table["doc_id"].fill_null(LAST).to_numpy()
        n = table["n"].to_numpy()
        norms = 100 - SLOPE + (SLOPE * n * documents) // length
        terms, counts = table["terms"].combine_chunks(), table["counts"].combine_chunks()
        sizes = np.diff(terms.offsets.to_numpy())
        part = Segment(ids, norms, sizes, terms.flatten().to_numpy(), counts.flatten().to_numpy())
        for q, (asked, factors) in enumerate(queries):
            lists = part.lists(asked, factors)
            if not lists:
                continue
            old_ids, old = best[q]
            # a document as good as the last of k may come first by its id, so the bar is that score itself
            bar = int(old[-1]) if len(old) == k else 1
            found, scores = nra(lists, len(ids), k, max(bar, 1))
            all_ids, all_scores = np.append(old_ids, part.ids[found]), np.append(old, scores)
            order = np.lexsort((all_ids, -all_scores))[:k]
            best[q] = all_ids[order], all_scores[order]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        best = [(none, none)] * len(queries)
        held: list[pa.RecordBatch] = []
        postings = 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column(2).flatten())
            if postings >= segment:
                solve(held, best)
                held, postings = [], 0
        if postings:
            solve(held, best)
        which = np.repeat(np.arange(len(best)), [len(ids) for ids, _ in best])
        ids = np.concatenate([none, *[ids for ids, _ in best]])
        scores = np.concatenate([none, *[scores for _, scores in best]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int32()), pa.array(ids, mask=ids == LAST), pa.array(scores)],
            ["query", "doc_id", "score"],
        )

    return index.select("doc_id", "n", "terms", "counts").mapInArrow(search, "query int, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, segment: int = SEGMENT, chars: int = QUERY_CHARS) -> DataFrame:
    """Rows ``item_id, rank, doc_id, score``: the best ``k`` documents of every query.

    ``docs`` has ``doc_id, text``, ``queries`` has ``item_id, text``.
    """
    ensure_columns(docs, "doc_id", "text")
    ensure_columns(queries, "item_id", "text")
    asked = queries.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // chars))
    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        found.append(_search_block(docs, [(r["item_id"], r["text"]) for r in rows], k, segment))
    return reduce(DataFrame.unionByName, found)


def _search_block(docs: DataFrame, rows: list[tuple[int | None, str]], k: int, segment: int) -> DataFrame:
    spark = docs.sparkSession
    bags: dict[int | None, Counter] = {}
    for item, text in rows:
        bags.setdefault(item, Counter()).update(terms_of(text))
    vocabulary = {t: i for i, t in enumerate(sorted({t for bag in bags.values() for t in bag}))}
    index = staged(forward_index(docs, vocabulary), "lexical-forward")
    sums = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = sums["documents"], sums["length"] or 1
    holding = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = {r["term"]: weight(r["count"], documents) for r in holding}
    items = sorted(bags, key=lambda item: (item is None, item or 0))
    asked = []
    for item in items:
        terms = sorted((vocabulary[t], n) for t, n in bags[item].items() if vocabulary[t] in weights)
        factors = [n * weights[t] for t, n in terms]
        asked.append((np.array([t for t, _ in terms], dtype=np.int64), np.array(factors, dtype=np.int64)))
    best = _best_of_tasks(index, asked, k, documents, length, segment)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items)), "query int, item_id long")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
