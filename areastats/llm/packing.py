"""Packing into optimal length buckets.

1. The lengths (words of the whole text) are written once to the shared folder.
2. Their global histogram, one row for each different length, goes to the driver as two columns
   of integers. d different lengths need d * (d + 1) / 2 words, so it has less than
   sqrt(2 * words of the corpus) rows: some thousands for gigabytes, under six million for 100 TB.
3. Dynamic programming over the lengths finds the ``buckets`` boundaries with the least padding
   in total (exact integers of any size; among equals the earliest boundaries).
4. Inside each bucket, documents in the order of their id form batches of
   ``max(1, token_budget // bucket length)``. The running number comes from range shards: a
   number within the shard plus the counts of the shards before it, so no bucket passes
   through one task.

Defined results: a null or empty text has length 0 and is packed like others; a text longer
than the budget is a batch of its own; rows that repeat an id (or have none) are packed each,
in an order that is stable within the run; an empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import materialise, shuffle_parts

BUCKETS = 16
TOKEN_BUDGET = 16384
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper lengths of the buckets with the least padding.

    ``lengths`` ascending, each with its count. cost(i, j) = padding when items i+1..j share a
    bucket; best positions move right with j, so each layer is solved by divide and conquer, one
    level of it (the middles of all its intervals) at a time.
    """
    n = len(lengths)
    if n == 0:
        return []
    far = np.iinfo(np.int64).max // 4
    kind = np.int64 if (int(lengths[-1]) + 1) * (int(counts.sum()) + 1) < far else object
    if kind is object:
        far = (int(lengths[-1]) + 1) * (int(counts.sum()) + 1)
    size = np.concatenate(([0], lengths)).astype(kind)
    c = np.concatenate(([0], np.cumsum(counts.astype(kind))))
    s = np.concatenate(([0], np.cumsum(counts.astype(kind) * size[1:])))
    prev = np.full(n + 1, far, kind)
    prev[0] = 0
    choice = []
    for _ in range(min(buckets, n)):
        cur, arg = np.full(n + 1, far, kind), np.zeros(n + 1, np.int32)
        lo, hi, a, b = (np.array([x], np.int64) for x in (1, n, 0, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            many = np.minimum(b, j - 1) - a + 1
            first = np.cumsum(many) - many
            i = np.arange(many.sum()) + np.repeat(a - first, many)
            at = np.repeat(j, many)
            total = prev[i] + size[at] * (c[at] - c[i]) - (s[at] - s[i])
            least = np.minimum.reduceat(total, first)
            equal = np.flatnonzero(total == np.repeat(least, many))
            best = i[equal[np.searchsorted(equal, first)]]
            cur[j], arg[j] = least, best
            lo, hi, a, b = (np.concatenate(x) for x in (
                (lo, j + 1), (j - 1, hi), (a, best), (best, b)))
            left = lo <= hi
            lo, hi, a, b = lo[left], hi[left], a[left], b[left]
        choice.append(arg)
        prev = cur
    out, j = [], n
    for arg in reversed(choice):
        out.append(int(lengths[j - 1]))
        j = int(arg[j])
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, key: str = "doc_id", text: str = "text",
         buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """``key``, n_tokens, bucket (from 0), bucket_len, batch (from 0 in its bucket), padding."""
    n = word_count(F.col(text)) if length is None else length.cast("long")
    lens = materialise(docs.select(F.col(key).alias("key"), n.alias("n_tokens"),
                                   F.monotonically_increasing_id().alias("row")), "pack-lengths")
    hist = lens.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow().sort_by("n_tokens")
    edges = boundaries(hist.column("n_tokens").to_numpy(), hist.column("n").to_numpy(), buckets) or [0]
    upper = F.array(*[F.lit(e).cast("long") for e in edges])
    bucket = F.size(F.filter(upper, lambda e: e < F.col("n_tokens")))
    shards = shuffle_parts(docs.sparkSession)
    placed = materialise(
        lens.withColumn("bucket", bucket).repartitionByRange(shards, "bucket", "key", "row")
        .withColumn("shard", F.spark_partition_id()), "pack-shards")
    before = (placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
              .select("bucket", "shard", (F.sum("n").over(
                  Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before")))
    own = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("key", "row")) - 1
    length_of = F.element_at(upper, F.col("bucket") + 1)
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(length_of, F.lit(1))))
    return (placed.withColumn("own", own).join(before, ["bucket", "shard"])
            .select(F.col("key").alias(key), "n_tokens", "bucket", length_of.alias("bucket_len"),
                    F.floor((F.col("before") + F.col("own")) / per_batch).alias("batch"),
                    (length_of - F.col("n_tokens")).alias("padding")))


#: The same in DuckDB: layer k of the recursion holds, for every length j, the least padding of
#: lengths 1..j in k buckets and the boundaries that give it.
SQL = f"""
WITH RECURSIVE lens AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
hist AS (
  SELECT row_number() OVER (ORDER BY n_tokens) AS j, n_tokens AS top, CAST(count(*) AS BIGINT) AS n,
    CAST(count(*) * n_tokens AS BIGINT) AS s FROM lens GROUP BY n_tokens),
cum AS (
  SELECT j, top, CAST(sum(n) OVER (ORDER BY j) AS BIGINT) AS c, CAST(sum(s) OVER (ORDER BY j) AS BIGINT) AS s FROM hist
  UNION ALL SELECT 0, 0, 0, 0),
dp AS (
  SELECT 0 AS k, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS cost, CAST([] AS BIGINT[]) AS edges
  UNION ALL
  SELECT k + 1, j, best.c, list_append(best.e, top) FROM (
    SELECT p.k, cj.j, cj.top,
      min({{'c': p.cost + cj.top * (cj.c - ci.c) - (cj.s - ci.s), 'i': p.j, 'e': p.edges}}) AS best
    FROM dp p JOIN cum ci ON ci.j = p.j JOIN cum cj ON cj.j > p.j
    WHERE p.k < {BUCKETS} GROUP BY p.k, cj.j, cj.top)),
edges AS (
  SELECT edges FROM dp WHERE j = (SELECT max(j) FROM cum) ORDER BY k DESC LIMIT 1),
placed AS (
  SELECT doc_id, n_tokens, CAST(len(list_filter(edges, lambda e: e < n_tokens)) AS INTEGER) AS bucket, edges FROM lens, edges)
SELECT doc_id, n_tokens, bucket, edges[bucket + 1] AS bucket_len,
  CAST((row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1)
    // greatest(1, {TOKEN_BUDGET} // greatest(edges[bucket + 1], 1)) AS BIGINT) AS batch,
  edges[bucket + 1] - n_tokens AS padding
FROM placed
"""
