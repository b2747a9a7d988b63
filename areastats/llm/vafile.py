"""Exact top-k inner-product search by a vector-approximation file.

1. Every vector component becomes an integer (``floor(scale * x)``) and a cell number of one
   byte; the cell grid (one step per dimension, from the corpus minimum and maximum) makes the
   approximation file. Of rows with the same vector only those that can be among k results are
   candidates: k rows of each of the k + 1 smallest ids.
2. Scan. Cells and queries are dealt into blocks, and each block of cells meets each block of
   queries. The cells give an upper and a lower bound of every score. A row stays for a query
   if its upper bound reaches the k-th best lower bound of the block, and afterwards the k-th
   best over all blocks.
3. Read. Only rows that stay send their exact vectors, once to each block of queries that
   wants them. They are read in the order of their upper bounds until the k-th exact score
   beats every bound still unread; the k best of all blocks are merged per query.

So what is copied to every block of queries is a byte per component, and neither a block nor a
query's candidates pass through one task whole.

Defined results: a null vector, one with a null or non-finite component, an empty one or one
with a null id takes no part. Vectors are compared only with vectors of the same length. Rows
that share the query's id are its own row. Ties go to the smaller id; among repeated rows of
one id each counts. Fewer than k candidates: all are returned. Scores are exact at any size:
where the corpus's extremes allow sums from 2^53 on, products are summed as unbounded
integers. An integer component of 2^62 or more, or a k-best score that 64 bits can't hold,
raises instead of saturating.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import materialise

CELLS = 256                      # of a dimension: one byte


def integers(df: DataFrame, key: str, vector: str, scale: int, is_query: Column) -> DataFrame:
    """key, dim, v, is_query: the integer vectors of the rows that take part."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return (df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
            .select(F.col(key).cast("long").alias("key"), F.size(vector).alias("dim"),
                    F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
                    .alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")))


def _matrix(column, kind: type) -> np.ndarray:
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(col), -1)


def _joined(column) -> np.ndarray:
    """Byte strings of the same length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def screen(queries: np.ndarray, query_ids: np.ndarray, cells: np.ndarray, ids: np.ndarray,
           low: np.ndarray, step: np.ndarray, k: int):
    """For every query: the rows that may be among its k best by their cells (positions),
    their upper bounds, and the k best lower bounds.

    Bounds are exact for sums below 2^53. Beyond, ``queries`` holds Python integers, and the
    bounds are widened by more than float64 can be wrong by.
    """
    slack = 2.0 ** -40 if queries.dtype == object else 0.0
    queries = queries.astype(np.float64)
    floor_ = low + cells * step                      # every component lies in [floor_, ceil_]
    ceil_ = np.minimum(floor_ + step - 1, low + CELLS * step - 1)
    most = np.maximum(np.abs(floor_), np.abs(ceil_)) + step if slack else None
    for a in range(0, len(queries), 32):
        q = queries[a:a + 32]
        up_q, down_q = np.maximum(q, 0), np.minimum(q, 0)
        upper = up_q @ ceil_.T + down_q @ floor_.T
        lower = up_q @ floor_.T + down_q @ ceil_.T
        if slack:                                    # by the sum of the terms' absolute values
            wide = slack * (np.abs(q) @ most.T + 1)
            upper, lower = upper + wide, lower - wide
        own = query_ids[a:a + 32, None] == ids[None, :]
        lower[own] = -np.inf
        best = -np.sort(-(np.partition(lower, len(ids) - k, axis=1)[:, -k:] if len(ids) > k else lower), axis=1)
        kth = best[:, k - 1] if len(ids) >= k else np.full(len(q), -np.inf)
        for i in range(len(q)):
            at = np.flatnonzero((upper[i] >= kth[i]) & ~own[i])
            yield at, upper[i][at], best[i][best[i] > -np.inf]


def read_in_order(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, upper: np.ndarray, k: int):
    """The k best rows (positions) and their exact scores, read from the highest bound down."""
    order = np.argsort(-upper, kind="stable")
    best_at, best = np.zeros(0, np.int64), np.zeros(0, vectors.dtype)
    for c in range(0, len(order), 64):
        part = order[c:c + 64]
        if len(best) >= k and upper[part[0]] < best[k - 1]:
            break                                    # no unread row can reach the k-th score
        best_at = np.concatenate((best_at, part))
        best = np.concatenate((best, vectors[part] @ query))
        by_id = np.argsort(ids[best_at], kind="stable")
        top = by_id[np.argsort(-best[by_id], kind="stable")][:k]
        best_at, best = best_at[top], best[top]
    return best_at, [int(x) for x in best]


def _grid(rows: DataFrame, vector: str, scale: int) -> tuple[dict, int, int]:
    """By length of vector: lowest values, steps and the type that sums are exact in; the
    number of rows and of queries. One row per component position is collected: as many as the
    longest vector has, never per row."""
    extremes = (rows.select("dim", "is_query", F.posexplode("v").alias("at", "x"))
                .groupBy("dim", "at")
                .agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"),
                     F.count_if("is_query").alias("q")).collect())
    parts: dict[int, list] = {}
    for dim, at, low, high, _, _ in extremes:
        parts.setdefault(dim, []).append((at, low, high))
    grid = {}
    for dim, found in parts.items():
        low = np.array([p[1] for p in sorted(found)], np.float64)
        high = np.array([p[2] for p in sorted(found)], np.float64)
        most = [max(abs(p[1]), abs(p[2])) for p in found]
        if max(most) >= 1 << 62:
            raise ValueError(f"components of {vector} are beyond 62 bits after scaling by {scale}")
        # a sum of products, and any part of it, stays below the sum of the squares of the extremes
        kind = np.float64 if sum((m + 1) ** 2 for m in most) < 1 << 52 else object
        grid[dim] = (low, np.maximum(1, np.ceil((high - low + 1) / CELLS)), kind)
    first = [e for e in extremes if e["at"] == 0]
    return grid, max(1, sum(e["n"] for e in first)), max(1, sum(e["q"] for e in first))


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id",
          vector: str = "embedding", scale: int = 256, block_rows: int = 32768,
          query_block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), ``key``, score: the k best rows of every query.

    ``is_query`` marks the rows that are queries. The number of blocks follows the number of
    rows; a group holds one block of cells and one block of queries, or the exact vectors of
    one block that its queries want.
    """
    rows = materialise(integers(df, key, vector, scale, is_query)
                       .withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    grid, n_rows, n_queries = _grid(rows, vector, scale)
    n_blocks, n_query_blocks = -(-n_rows // block_rows), -(-n_queries // query_block)
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where("is_query").select("dim", block(n_query_blocks).alias("qb"), "row", "key", "v")
    copies = Window.partitionBy("v", "key").orderBy("row")
    ids = Window.partitionBy("v").orderBy("key")
    exact = materialise(
        rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k)
        .withColumn("n", F.dense_rank().over(ids)).where(F.col("n") <= k + 1)
        .select("dim", block(n_blocks).alias("rb"), "row", "key", "v"), "topk-candidates")

    def quantise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = b.column(4)
            flat, off = v.flatten().to_numpy(), v.offsets.to_numpy() - v.offsets[0].as_py()
            dims, out = b.column(0).to_numpy(), [b""] * b.num_rows
            for dim in np.unique(dims):
                low, step, _ = grid[int(dim)]
                mine = np.flatnonzero(dims == dim)
                x = flat[off[mine][:, None] + np.arange(dim)].astype(np.float64)
                cells = np.clip(np.floor((x - low) / step), 0, CELLS - 1).astype(np.uint8)
                for i, own in zip(mine, cells):
                    out[i] = own.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())],
                                             names=["dim", "rb", "row", "key", "cells"])

    cells = (exact.mapInArrow(quantise, "dim int, rb int, row long, key long, cells binary")
             .withColumn("qb", every(n_query_blocks)))
    asked = queries.withColumn("rb", every(n_blocks))

    def scan(q: pa.Table, r: pa.Table) -> pa.Table:
        of, row, upper, best = [], [], [], []
        if q.num_rows and r.num_rows:
            low, step, kind = grid[q.column("dim")[0].as_py()]
            row_of = r.column("row").to_numpy()
            for name, (at, up, lows) in zip(q.column("row").to_pylist(), screen(
                    _matrix(q.column("v"), kind), q.column("key").to_numpy(), _joined(r.column("cells")),
                    r.column("key").to_numpy(), low, step, k)):
                of.append(name)
                row.append(row_of[at])
                upper.append(up)
                best.append(lows)
        n = len(of)
        same = lambda name: pa.array([q.column(name)[0].as_py()] * n if n else [], pa.int32())
        return pa.table([same("dim"), same("qb"), same("rb"), pa.array(of, pa.int64()),
                         pa.array(row, pa.list_(pa.int64())), pa.array(upper, pa.list_(pa.float64())),
                         pa.array(best, pa.list_(pa.float64()))],
                        names=["dim", "qb", "rb", "q", "rows", "upper", "best"])

    scanned = materialise(
        asked.groupBy("dim", "qb", "rb").cogroup(cells.groupBy("dim", "qb", "rb"))
        .applyInArrow(scan, "dim int, qb int, rb int, q long, rows array<long>, upper array<double>, best array<double>"),
        "topk-bounds")
    falling = Window.partitionBy("q").orderBy(F.desc("low"))
    kth = (scanned.select("q", F.explode("best").alias("low"))
           .withColumn("n", F.row_number().over(falling)).where(F.col("n") <= k)
           .groupBy("q").agg(F.min("low").alias("low"), F.count("*").alias("n"))
           .where(F.col("n") == k).select("q", "low"))
    pairs = (scanned.join(kth, "q", "left")
             .select("dim", "qb", "rb", "q", "low", F.explode(F.arrays_zip("rows", "upper")).alias("p"))
             .select("dim", "qb", "rb", "q", F.col("p.rows").alias("row"), F.col("p.upper").alias("upper"), "low")
             .where(F.col("low").isNull() | (F.col("upper") >= F.col("low"))).drop("low"))
    wanted = pairs.select("qb", "row").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    meeting = (
        asked.select("dim", "qb", "rb", F.lit(0).alias("kind"), F.col("row").alias("q"), none("long").alias("row"),
                     "key", none("double").alias("upper"), "v")
        .unionByName(exact.join(wanted, "row").select(
            "dim", "qb", "rb", F.lit(1).alias("kind"), none("long").alias("q"), "row", "key",
            none("double").alias("upper"), "v"))
        .unionByName(pairs.select("dim", "qb", "rb", F.lit(2).alias("kind"), "q", "row", none("long").alias("key"),
                                  "upper", none("array<bigint>").alias("v"))))

    def read(t: pa.Table) -> pa.Table:
        a, b, c = [], [], []
        q, r, p = (t.filter(pc.equal(t.column("kind"), i)) for i in range(3))
        if q.num_rows and p.num_rows:
            kind = grid[t.column("dim")[0].as_py()][2]
            r, p = r.sort_by("row"), p.sort_by("q")
            vectors, ids_ = _matrix(r.column("v"), kind), r.column("key").to_numpy()
            at = np.searchsorted(r.column("row").to_numpy(), p.column("row").to_numpy())
            of, upper = p.column("q").to_numpy(), p.column("upper").to_numpy()
            for name, qid, x in zip(q.column("q").to_pylist(), q.column("key").to_pylist(),
                                    _matrix(q.column("v"), kind)):
                lo, hi = np.searchsorted(of, [name, name + 1])
                mine = at[lo:hi]
                best, scores = read_in_order(x, vectors[mine], ids_[mine], upper[lo:hi], k)
                if any(not -(1 << 63) <= s < 1 << 63 for s in scores):
                    raise OverflowError(f"a score of {qid} is beyond 64 bits")
                a.append(np.full(len(best), qid, np.int64))
                b.append(ids_[mine][best])
                c.append(np.array(scores, np.int64))
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table([cat(a), cat(b), cat(c)], names=["query_id", "key", "score"])

    found = meeting.groupBy("dim", "qb", "rb").applyInArrow(read, "query_id long, key long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("key"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"))


SQL = """
WITH r AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM r q JOIN r c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
