"""Nearest neighbours of stated queries by a block matrix join.

Vectors are packed into blocks of rows. A tile is the product of a query block and a candidate block: both sides are
quantised to int8 with a scale for each vector, and the product of the integers gives approximate inner products whose
error is bounded by  |q - q'| * |c| + |q'| * |c - c'|. Pairs whose upper bound lies below the query's k-th best lower
bound can't be among its k nearest; the others are recomputed in double precision and enter the query's heap. The
result is exact. Every candidate block is read once; query blocks go to each of a number of groups of candidate blocks,
the groups being as many as keep a task's work bounded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a query block, of a candidate block, and candidate rows that one task meets.
QUERY_ROWS, CANDIDATE_ROWS, GROUP_ROWS = 512, 2048, 16_384
#: Dimensions whose products of int8 values stay below 2**24 in sum.
EXACT = 1024


def usable(vector: Column) -> Column:
    """True for vectors of finite numbers that are not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def blocks(vectors: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """Pack each input partition's vectors: (dim, n, ids, data), ids as int64 and data as doubles or floats."""
    wide = dict(vectors.dtypes)[vector] != "array<float>"
    kind = np.float64 if wide else np.float32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([len(ids)]), pa.array([ids.tobytes()]), pa.array([data.astype(kind).tobytes()])], ["dim", "n", "ids", "data"])

        for batch in batches:
            column, ids = batch.column(vector), batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.diff(np.asarray(column.offsets))
            values, first = np.asarray(column.values, kind), np.asarray(column.offsets)[:-1]
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                for a in range(0, len(own), rows):
                    part = own[a : a + rows]
                    held.setdefault(dim, []).append((ids[part], values[first[part][:, None] + np.arange(dim)]))
                    if sum(len(x[0]) for x in held[dim]) >= rows:
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    return vectors.select(key, vector).mapInArrow(pack, "dim long, n long, ids binary, data binary")


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, the vectors' largest components, and norms of the vectors and of the errors in units of these."""
    top = np.maximum(np.abs(x).max(axis=1), 1e-300)
    unit = x / top[:, None]  # so that no norm overflows
    q = np.rint(unit * 127)
    return q.astype(np.int8), top, np.linalg.norm(unit, axis=1), np.linalg.norm(unit - q / 127, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 rows, exact: float32 holds the sums of EXACT dimensions without rounding, and those are added up."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT):
        out += a[:, d : d + EXACT].astype(np.float32) @ b[:, d : d + EXACT].astype(np.float32).T
    return out


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best candidates within the tile: (query's row, candidate ids, scores), exact.

    Bounds are in units of the query's largest component and the tile's largest one, which don't change the order.
    """
    q8, _, qn, qe = _quantised(q)
    c8, top, cn, ce = _quantised(c)
    weight = top / top.max(initial=1e-300)
    near = products(q8, c8) / 127**2 * weight[None, :]
    slack = (qe[:, None] * (cn * weight)[None, :] + (qn + qe)[:, None] * (ce * weight)[None, :]) * (1 + 1e-6) + 1e-12
    low = near - slack
    same = q_ids[:, None] == c_ids[None, :]
    low[same] = -np.inf
    bar = np.partition(low, len(c_ids) - k, axis=1)[:, len(c_ids) - k] if len(c_ids) > k else np.full(len(q_ids), -np.inf)
    alive = (near + slack >= bar[:, None]) & ~same
    for i in range(len(q_ids)):
        own = np.flatnonzero(alive[i])
        if len(own):
            exact = (c[own] * q[i]).sum(axis=1)
            best = np.lexsort((c_ids[own], -exact))[:k]
            yield i, c_ids[own[best]], exact[best]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each query by inner product: query_id, rank, vec_id, score; ties go to the smaller id.

    Candidates are all rows but those with the query's own id; fewer than k come back if there are fewer. Vectors that
    are null, zero, or hold nulls or numbers that are not finite take no part, nor do rows without an id or pairs of
    different dimension. Rows that repeat an id and vector count once; those with an id and other vectors count each.
    An empty table or no query gives no rows; further columns are ignored.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).dropDuplicates(["id", "v"])
    n = rows.count()
    groups = max(1, -(-n // GROUP_ROWS))
    queries = blocks(rows.where("asks"), "id", "v", QUERY_ROWS).withColumnsRenamed({"n": "qn", "ids": "qids", "data": "qdata"})
    queries = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    candidates = blocks(rows, "id", "v", CANDIDATE_ROWS).withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    kind = np.float64 if dict(vectors.dtypes)[vector] != "array<float>" else np.float32

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            heaps: dict[tuple[int, bytes], list[tuple[float, int]]] = {}
            for r in frame.itertuples():
                q_ids, c_ids = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                q = np.frombuffer(r.qdata, kind).reshape(len(q_ids), -1).astype(np.float64)
                c = np.frombuffer(r.data, kind).reshape(len(c_ids), -1).astype(np.float64)
                for i, ids, scores in tile(q_ids, q, c_ids, c, k):
                    heap = heaps.setdefault((int(q_ids[i]), q[i].tobytes()), [])
                    for item in zip(scores.tolist(), (-ids).tolist(), strict=True):
                        if len(heap) < k:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)
            found = [(q, -i, s) for (q, _), heap in heaps.items() for s, i in heap]
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    tiles = queries.join(candidates.hint("shuffle_hash"), ["group", "dim"])
    best = tiles.select("qids", "qdata", "ids", "data").mapInPandas(multiply, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
