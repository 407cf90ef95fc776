"""Ranked lexical search of a stated set of items over all documents, by norm buckets of impact vectors.

Documents become sparse vectors over the terms of the items: an impact for each term, times the root of the term's
weight; an item has its terms' repeats times the same root, so that their product is the score. Vectors are ordered by
their length over the whole table and searched in buckets of BUCKET, the longest first:

* a bucket whose longest vector, times the item's length, can't reach the item's k-th best score is left out for this
  item (Cauchy and Schwarz), and so is every vector after it;
* inside a bucket the item's FOCUS heaviest coordinates are multiplied out, and the rest is bounded by the product of the
  lengths of what remains of both; pairs whose bound lies below the k-th best score are left out;
* what survives is scored exactly in 64-bit integers and enters the item's heap.

The longest vectors (LONG of all) are searched first; the k-th best scores found there are the bars that all other tasks
start with. Bounds are doubles, widened by more than their rounding errors, so that no pair is lost.

Items go in blocks of bounded size: those of one pass have at most VOCABULARY terms together, and a block's table of terms
by items at most CELLS entries; more items take more passes. Terms are 64-bit hashes of their bytes: the chance that a
term of the corpus is taken for one of the items' is below one in a million at a thousand million different terms.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelscan.llm.shared import Words, pieces, stored

#: Bytes between terms: all of ASCII but digits and letters.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
VOCABULARY, CELLS = 1 << 20, 1 << 22
BUCKET, FOCUS, LONG = 512, 12, 1 / 32
#: Entries of surviving pairs that are scored at once, or one pair's.
ENTRIES = 1 << 19
#: Widening of bounds, which are sums of some hundred doubles.
SLACK = 1e-9


@dataclass
class Item:
    """An item's id and its terms' hashes, repeats included."""

    id: object
    terms: np.ndarray


def passes(items: DataFrame) -> Iterator[list[Item]]:
    """Items with at least one term, in lists of at most VOCABULARY terms; they come to the driver a partition at a time."""
    held, room = [], VOCABULARY
    for r in items.toLocalIterator():
        terms = Words(pa.array([r["text"]], pa.string()), lower=True, separators=BETWEEN).hashes
        if not len(terms):
            continue
        if held and len(terms) > room:
            yield held
            held, room = [], VOCABULARY
        held.append(Item(r["item_id"], terms))
        room -= len(terms)
    if held:
        yield held


def counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, ids, tfs): terms of each document with any, and places in the sorted vocabulary and occurrences of those in it."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = Words(part.column("text"), lower=True, separators=BETWEEN)
                at = np.minimum(np.searchsorted(vocabulary, w.hashes), size - 1)
                known = vocabulary[at] == w.hashes
                cell, tf = np.unique(w.docs[known] * size + at[known], return_counts=True)
                offsets = pa.array(np.searchsorted(cell // size, np.arange(w.n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (cell % size, tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.counts.astype(np.int64)), *lists], ["doc_id", "n", "ids", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>").where("n > 0")


def weights(vectors: DataFrame, n: int, size: int) -> np.ndarray:
    """Weight of each term of the vocabulary."""
    df = np.zeros(size, np.int64)
    for r in vectors.select(F.explode("ids").alias("id")).groupBy("id").count().toLocalIterator():  # at most VOCABULARY rows
        df[r["id"]] = r["count"]
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(vectors: DataFrame, n: int, total: int, weight: np.ndarray) -> DataFrame:
    """(doc_id, norm, ids, impacts) of the documents that hold terms of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tfs = batch.column("ids"), batch.column("tfs")
            length, lists = np.asarray(batch.column("n")), np.asarray(ids.offsets)
            t, tf = np.asarray(ids.flatten()), np.asarray(tfs.flatten()).astype(np.int64)
            m = np.repeat(25 + 75 * length * n // total, np.diff(lists))
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
            squares = np.concatenate(([0.0], np.cumsum(weight[t] * impact.astype(float) ** 2)))
            norm = np.sqrt(np.maximum(squares[lists[1:] - lists[0]] - squares[lists[:-1] - lists[0]], 0))
            offsets = pa.array((lists - lists[0]).astype(np.int32))
            both = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (t, impact)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(norm), *both], ["doc_id", "norm", "ids", "impacts"])

    return vectors.where("size(ids) > 0").mapInArrow(run, "doc_id long, norm double, ids array<int>, impacts array<int>")


def blocks(items: list[Item]) -> Iterator[list[Item]]:
    """The items in their order, as many at a time as a table of CELLS has room for."""
    held: list[Item] = []
    seen: set[int] = set()
    for i in items:
        more = seen.union(i.terms.tolist())
        if held and len(more) * (len(held) + 1) > CELLS:
            yield held
            held, more = [], set(i.terms.tolist())
        held.append(i)
        seen = more
    if held:
        yield held


class Block:
    """Some items as a table of the terms they hold, with their lengths and heaviest coordinates."""

    def __init__(self, items: list[Item], vocabulary: np.ndarray, weight: np.ndarray):
        at = [np.unique(np.searchsorted(vocabulary, i.terms), return_counts=True) for i in items]
        self.n = len(items)
        self.terms = np.unique(np.concatenate([t for t, _ in at]))
        self.local = np.full(len(vocabulary), -1, np.int32)
        self.local[self.terms] = np.arange(len(self.terms))
        self.root = np.sqrt(weight[self.terms].astype(float))
        self.points = np.zeros((len(self.terms), self.n), np.int64)
        for i, (t, repeats) in enumerate(at):
            self.points[self.local[t], i] = weight[t] * repeats
        heavy = self.points / np.maximum(self.root, 1e-300)[:, None]  # repeats times the root of the weight
        self.norm = np.sqrt((heavy**2).sum(axis=0))
        order = np.argsort(-heavy, axis=0, kind="stable")[:FOCUS]
        chosen = np.zeros(heavy.shape, bool)
        np.put_along_axis(chosen, order, True, axis=0)
        chosen &= heavy > 0
        self.rest = np.sqrt(np.maximum((np.where(chosen, 0, heavy) ** 2).sum(axis=0), 0))
        term, self.of = np.nonzero(chosen)  # by term
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.heavy = heavy[term, self.of]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the range and place within all ranges' values, for each value of ranges with these starts and sizes."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of]


class Search:
    """Heaps of a block's items."""

    def __init__(self, block: Block, bars: np.ndarray, k: int):
        self.b, self.k = block, k
        self.bars = np.maximum(bars, 1)  # a score of 0 is none
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(block.n)]

    def bucket(self, ids: np.ndarray, known: np.ndarray, norm: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Documents (id, whether they have one, length), longest first, and their entries by document: document's row, term, impact."""
        b = self.b
        open_ = b.norm * norm[0] * (1 + SLACK) >= self.bars
        if not open_.any():
            return
        inside = b.local[term] >= 0
        doc, term, impact = doc[inside], b.local[term[inside]], impact[inside].astype(np.int64)
        value = b.root[term] * impact
        of, at = _spread(b.first[term], b.first[term + 1] - b.first[term])
        cell = doc[of] * b.n + b.of[at]
        cells = len(ids) * b.n
        near = np.bincount(cell, value[of] * b.heavy[at], cells).reshape(len(ids), b.n)
        seen = np.bincount(cell, value[of] ** 2, cells).reshape(len(ids), b.n)
        # what remains of a length is a difference of sums: their rounding is widened too
        left = np.sqrt(np.maximum(norm[:, None] ** 2 * (1 + SLACK) - seen * (1 - SLACK), 0))
        alive = ((near + b.rest * left) * (1 + SLACK) >= self.bars) & open_
        d, q = np.nonzero(alive)
        if not len(d):
            return
        first = np.searchsorted(doc, np.arange(len(ids) + 1))
        sizes = first[d + 1] - first[d]
        ends = np.cumsum(sizes)
        score = np.empty(len(d), np.int64)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + ENTRIES, ENTRIES)))
        for a, z in zip(cuts[:-1], [*cuts[1:-1], len(d)], strict=True):
            pair, at = _spread(first[d[a:z]], sizes[a:z])
            sums = np.concatenate(([0], np.cumsum(b.points[term[at], q[a:z][pair]] * impact[at])))
            score[a:z] = sums[ends[a:z] - ends[a] + sizes[a]] - sums[ends[a:z] - ends[a] + sizes[a] - sizes[a:z]]
        good = np.flatnonzero(score >= self.bars[q])
        good = good[np.lexsort((ids[d[good]], ~known[d[good]], -score[good], q[good]))]
        for i, a, z in zip(*_groups(q[good]), strict=True):
            heap = self.heaps[i]
            for j in good[a : min(z, a + self.k)].tolist():
                entry = (int(score[j]), bool(known[d[j]]), -int(ids[d[j]]))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.bars[i] = max(self.bars[i], heap[0][0])


def _groups(sorted_: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    if not len(sorted_):
        return [], [], []
    starts = np.concatenate(([0], np.flatnonzero(np.diff(sorted_)) + 1))
    return sorted_[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_)]


def search(vectors: DataFrame, block: Block, bars: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): what each task finds best for each item of the block, of those that reach the item's bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Search(block, bars.copy(), k)
        for batch in batches:
            norm = np.asarray(batch.column("norm"))
            order = np.argsort(-norm, kind="stable")
            ids, known = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), ~np.asarray(batch.column("doc_id").is_null())
            lists = np.asarray(batch.column("ids").offsets) - batch.column("ids").offsets[0].as_py()
            term, impact = np.asarray(batch.column("ids").flatten()), np.asarray(batch.column("impacts").flatten())
            for a in range(0, len(order), BUCKET):
                own = order[a : a + BUCKET]
                doc, at = _spread(lists[own], lists[own + 1] - lists[own])
                s.bucket(ids[own], known[own], norm[own], doc, term[at], impact[at])
        found = [(i, -d if known else None, score) for i, heap in enumerate(s.heaps) for score, known, d in heap]
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k documents of highest score for each item: (item_id, rank, doc_id, score), equal scores by ascending doc_id.

    Every row of docs (doc_id, text) is a document and every row of items (item_id, text) an item, repeated ones too; a
    document without an id comes after those with one. Null and empty texts have no terms: such documents count nowhere
    and such items find nothing. Empty tables give no rows, further columns are ignored.
    """
    spark = docs.sparkSession
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    out = None
    for group in passes(items.select("item_id", "text")):
        vocabulary = np.unique(np.concatenate([i.terms for i in group]))
        vectors = stored(counts(docs, vocabulary), "terms")
        n, total = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n:
            break
        weight = weights(vectors, n, len(vocabulary))
        longest = F.desc("norm")
        ordered = stored(stored(impacts(vectors, n, total, weight), "impacts").repartitionByRange(longest).sortWithinPartitions(longest), "norms")
        cut = ordered.agg(F.percentile_approx("norm", 1 - LONG, 10_000)).first()[0] or 0.0
        for part in blocks(group):
            block = Block(part, vocabulary, weight)
            first = stored(search(ordered.where(F.col("norm") >= cut), block, np.zeros(block.n, np.int64), k), "found")
            bars = np.zeros(block.n, np.int64)
            for r in _best(first, k).where(F.col("rank") == k).select("item", "score").collect():  # a row for each item
                bars[r["item"]] = r["score"]
            found = _best(first.union(search(ordered.where(F.col("norm") < cut), block, bars, k)), k)
            named = spark.createDataFrame([(j, i.id) for j, i in enumerate(part)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
            found = found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # a row for each item
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out
