"""Ranked lexical search: a trie of restricted term vectors, searched by branch and bound.

1. One pass over the texts keeps, of each document, its length in terms and a vector of the
   items' terms with their frequencies (restricted term vector). It is written once; N, L and
   the document frequencies are aggregated from it.
2. Each task builds tries of its documents' vectors (documents of similar length together),
   terms in order of frequency, the rarest first, so that the bound on what may follow falls
   fast. Documents that begin with the same terms share their path; paths without a fork are
   one node. A node knows the largest frequency of each of its terms and the smallest m in its
   subtree.
3. All items go down depth first. At a node an item's bound is what the node's path can give
   plus what its later terms can give at most; an item that can't reach its k-th best score
   any more leaves the subtree, and a subtree without items is left. Documents reached are
   scored exactly. The best k of a task carry over from one trie to the next.
4. The best k of the tasks are merged in two rounds of windows.

Items are taken in groups of ``item_group`` (checked size of what is broadcast), one pass over
the vectors each.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z
lowered; they are compared by their bytes. Scores are 64-bit integers; m is computed in wider
integers where a product could pass 64 bits.

Defined results: null or empty texts have no terms and are not counted; null or empty items
match nothing; repeated documents are ranked each, equal scores by id with null ids last;
repeated items (same id and text) give one list, items of one id with different texts are told
apart by a list number in ``search``; an empty table gives no rows; extra columns are ignored;
a document with more than ``node_terms`` terms of the items is handled like any other.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ._spark import map_in_arrow, materialise
from ._text import slices, utf8, word_hashes
from .phrases import same_bytes, spell

_TERM = np.ones(256, bool)
_TERM[:128] = False
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Documents of one trie, and items searched together.
TRIE_DOCS = 1 << 14
ITEM_GROUP = 1 << 12


def terms_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms, and each text's offsets among them."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    word = _TERM[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    first[off[off < n]] = True
    first &= word
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(word[1:], out=last[:-1])
    last[off[off > 0] - 1] = True
    last &= word
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def terms_of_text(text: str | None) -> list[bytes]:
    data, off = utf8(pa.array([text or ""]))
    data = _LOWER[data]
    starts, ends, _ = terms_of(data, off)
    return [data[s:e].tobytes() for s, e in zip(starts, ends)]


class Vocabulary:
    """The items' distinct terms, found by hash and verified by their bytes."""

    def __init__(self, terms: list[bytes]):
        self.raw = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        starts = ends - np.array([len(t) for t in terms], np.int64)
        hashes = word_hashes(self.raw, starts, ends)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.number, self.starts, self.size = hashes[order], order, starts[order], (ends - starts)[order]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two terms of the items have one hash")
        self.mask = np.uint64((1 << max(16, (8 * len(terms)).bit_length())) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[(self.hashes & self.mask).astype(np.int64)] = True

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given words are terms of the items, and the numbers of those."""
        hashes = word_hashes(data, starts, ends)
        hit = np.flatnonzero(self.maybe[(hashes & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[hit]), len(self.hashes) - 1)
        size = (ends - starts)[hit]
        same = (self.hashes[at] == hashes[hit]) & (self.size[at] == size)
        hit, at, size = hit[same], at[same], size[same]
        both = np.concatenate((data, self.raw))
        if not same_bytes(both, starts[hit], self.starts[at] + len(data), size):
            own = [i for i, (s, k, z) in enumerate(zip(starts[hit], self.starts[at], size))
                   if np.array_equal(data[s:s + z], self.raw[k:k + z])]
            hit, at = hit[own], at[own]
        return hit, self.number[at]


def _vectors(vocabulary):
    """c0 id, c1 number of terms, c2 the items' terms in the text, c3 how often each stands in it."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = vocabulary.value
        for whole in it:
            for b in slices(whole, "c1"):
                data, off = utf8(b.column(1))
                data = _LOWER[data]
                starts, ends, first = terms_of(data, off)
                n = np.diff(first)
                hit, term = known.find(data, starts, ends)
                text = np.searchsorted(first, hit, side="right") - 1
                both, tf = np.unique((text << 32) | term, return_counts=True)
                size = np.bincount(both >> 32, minlength=len(n))
                list_off = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(list_off, pa.array(both & 0xFFFFFFFF, pa.int32())),
                     pa.ListArray.from_arrays(list_off, pa.array(tf, pa.int64()))], names=["c0", "c1", "c2", "c3"])
                yield out.filter(pa.array(n > 0))

    return run


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The contract's (1000000000 * tf) div (1000 * tf + 8 * m): grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def norm(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """m of documents with n terms: 25 + (75 * n * docs) div length."""
    if len(n) and 75 * int(n.max()) * docs >= 1 << 63:
        return np.array([25 + 75 * int(x) * docs // length for x in n], np.int64)
    return 25 + (75 * n * docs) // length


class Items:
    """Postings of the items by term, terms numbered by frequency, the rarest first."""

    def __init__(self, items: list[list[int]], df: dict[int, int], docs: int):
        """items: their term numbers with repeats; df: of each term that occurs in documents."""
        order = sorted(df, key=lambda t: (df[t], t))
        self.rank = np.full(max(order, default=-1) + 2, -1, np.int64)
        self.rank[order] = np.arange(len(order))
        self.size = len(items)
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) for t in order], np.int64)
        pairs = []
        for i, terms in enumerate(items):
            known = [self.rank[t] for t in terms if t < len(self.rank) and self.rank[t] >= 0]
            rank, times = np.unique(np.array(known, np.int64), return_counts=True)
            pairs.append(np.column_stack((rank, np.full(len(rank), i), times * self.weight[rank])))
        flat = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        flat = flat[np.lexsort((flat[:, 1], flat[:, 0]))].astype(np.int64)
        self.start = np.searchsorted(flat[:, 0], np.arange(len(order) + 1))
        self.item, self.worth, self.term = flat[:, 1].copy(), flat[:, 2].copy(), flat[:, 0].copy()

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """Ranks of term numbers; -1 for terms of other groups of items."""
        return self.rank[np.minimum(terms, len(self.rank) - 1)]


class Best:
    """The k best documents of every item: a heap each, and the score a newcomer must reach."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.reach = np.ones(items, np.int64)

    def offer(self, item: int, score: int, order: tuple, key) -> None:
        heap, entry = self.heaps[item], (score, _Last(order), key)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif heap[0][:2] < entry[:2]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.reach[item] = max(1, heap[0][0])


class _Last:
    """Turns an order around: of equal scores the larger id is the lesser entry."""

    __slots__ = ("of",)

    def __init__(self, of):
        self.of = of

    def __lt__(self, other):
        return other.of < self.of

    def __eq__(self, other):
        return self.of == other.of


class Trie:
    """Documents in the order of their vectors; nodes are runs of documents with a common path."""

    def __init__(self, start: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray):
        """Vectors in CSR form (ranks ascending in each document) and m of each document."""
        raw = term.astype(">u4").tobytes()
        keys = [raw[4 * s:4 * e] for s, e in zip(start[:-1], start[1:])]
        self.doc = np.array(sorted(range(len(keys)), key=lambda i: keys[i]), np.int64)
        size = np.diff(start)[self.doc]
        self.start = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(self.start[-1]) + np.repeat(start[self.doc] - self.start[:-1], size)
        self.term, self.tf, self.m, self.size = term[at], tf[at], m[self.doc], size
        shared = self._shared()
        self._build(shared)

    def _shared(self) -> np.ndarray:
        """How many leading terms each document has in common with the one before it."""
        n = len(self.doc)
        common = np.zeros(n, np.int64)
        live = np.arange(1, n)
        depth = 0
        while len(live):
            live = live[(self.size[live] > depth) & (self.size[live - 1] > depth)]
            live = live[self.term[self.start[live] + depth] == self.term[self.start[live - 1] + depth]]
            depth += 1
            common[live] = depth
        return common

    def _build(self, common: np.ndarray) -> None:
        """Nodes (first document, last + 1, depth of the parent, own depth) in depth-first order."""
        n = len(self.doc)
        nodes: list[list[int]] = []                       # first, end, depth
        stack: list[int] = []
        for i, (c, s) in enumerate(zip(common.tolist(), self.size.tolist())):
            first = i
            while stack and nodes[stack[-1]][2] > c:
                top = nodes[stack.pop()]
                top[1], first = i, top[0]
            if not stack or nodes[stack[-1]][2] < c:
                nodes.append([first, n, c])
                stack.append(len(nodes) - 1)
            if s > c or not nodes:
                nodes.append([i, n, s])
                stack.append(len(nodes) - 1)
        if not nodes:
            nodes = [[0, n, 0]]
        node = np.array(nodes, np.int64)
        node = node[np.lexsort((node[:, 2], -node[:, 1], node[:, 0]))]
        self.first, self.end, self.depth = node[:, 0].copy(), node[:, 1].copy(), node[:, 2].copy()
        self.parent = np.full(len(node), -1, np.int64)
        path: list[int] = []
        for i, (a, z) in enumerate(zip(self.first.tolist(), self.end.tolist())):
            while path and self.end[path[-1]] <= a:
                path.pop()
            if path:
                self.parent[i] = path[-1]
            path.append(i)
        up = np.where(self.parent >= 0, self.depth[self.parent], 0)
        self.edge = np.column_stack((self.start[self.first] + up, self.start[self.first] + self.depth))
        # largest frequency of each term of the edge, smallest m, over the subtree
        self.least_m = np.minimum.reduceat(
            np.append(self.m, self.m[-1:]), np.column_stack((self.first, self.end)).ravel())[::2]
        self.top_tf = []
        for i, (a, z, u, d) in enumerate(zip(self.first, self.end, up, self.depth)):
            if z - a == 1:
                self.top_tf.append(self.tf[self.start[a] + u:self.start[a] + d])
            else:
                at = self.start[a:z, None] + np.arange(u, d)
                self.top_tf.append(self.tf[at].max(axis=0))
        self.after = np.arange(len(node)) + 1              # next node outside the subtree
        for i in range(len(node) - 1, -1, -1):
            p = self.parent[i]
            if p >= 0:
                self.after[p] = max(self.after[p], self.after[i])


def search_trie(trie: Trie, items: Items, best: Best, keys: list, orders: list) -> int:
    """Offers every document that can reach an item's k best; returns the documents scored."""
    top = np.zeros(len(items.weight), np.int64)
    np.maximum.at(top, trie.term, trie.tf)
    floor_m = trie.m.min()
    most = items.worth * gain(top, floor_m)[items.term]     # what a term can give an item here
    later = np.zeros(items.size, np.int64)
    np.add.at(later, items.item, most)
    given_at = {-1: (np.zeros(items.size, np.int64), later, -1)}
    scored, i, n = 0, 0, len(trie.first)
    open_nodes: list[int] = []
    while i < n:
        p = int(trie.parent[i])
        while open_nodes and open_nodes[-1] != p:
            del given_at[open_nodes.pop()]
        given, later, seen = given_at[p]
        a, z = trie.edge[i]
        m = trie.least_m[i]
        if z > a:
            given, terms = given.copy(), trie.term[a:z]
            reward = gain(trie.top_tf[i], m)
            last = int(terms[-1])
            for t, g in zip(terms.tolist(), reward.tolist()):
                q = slice(items.start[t], items.start[t + 1])
                given[items.item[q]] += items.worth[q] * g
            later = later.copy()
            q = slice(items.start[seen + 1], items.start[last + 1])
            np.subtract.at(later, items.item[q], most[q])
            seen = last
        bound = given + later
        if not (bound >= best.reach).any():
            i = int(trie.after[i])
            continue
        own = trie.end[i] if trie.after[i] == i + 1 else trie.first[i + 1]
        for d in range(int(trie.first[i]), int(own)):       # documents whose vector ends here
            if (given >= best.reach).any():
                scored += 1
                _score(trie, d, items, best, keys, orders)
        given_at[i] = (given, later, seen)
        open_nodes.append(i)
        i += 1
    return scored


def _score(trie: Trie, d: int, items: Items, best: Best, keys: list, orders: list) -> None:
    a, z = trie.start[d], trie.start[d + 1]
    score = np.zeros(items.size, np.int64)
    for t, g in zip(trie.term[a:z].tolist(), gain(trie.tf[a:z], trie.m[d]).tolist()):
        q = slice(items.start[t], items.start[t + 1])
        score[items.item[q]] += items.worth[q] * g
    own = int(trie.doc[d])
    for item in np.flatnonzero(score >= best.reach).tolist():
        best.offer(item, int(score[item]), orders[own], keys[own])


def _searcher(items, docs: int, length: int, k: int, key_type: pa.DataType):
    """c0 item number, c1 id, c2 score: the best k of the task's documents for each item."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = items.value
        best = Best(known.size, k)
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in it:
            for i in range(0, b.num_rows, TRIE_DOCS):
                part = b.slice(i, TRIE_DOCS)
                held, rows = held + [part], rows + part.num_rows
                if rows >= TRIE_DOCS:
                    _search_rows(held, known, best, docs, length)
                    held, rows = [], 0
        if held:
            _search_rows(held, known, best, docs, length)
        found = [(item, key, score) for item, heap in enumerate(best.heaps) for score, _, key in heap]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], key_type),
                 pa.array([f[2] for f in found], pa.int64())], names=["c0", "c1", "c2"])

    return run


def _search_rows(batches: list[pa.RecordBatch], items: Items, best: Best, docs: int, length: int) -> None:
    """Tries of the rows, one for each class of documents of similar m."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    n = rows.column("c1").to_numpy()
    terms, tf = (rows.column(c).combine_chunks() for c in ("c2", "c3"))
    off = np.concatenate(([0], np.cumsum(np.diff(terms.offsets.to_numpy()))))
    rank = items.ranks(terms.flatten().to_numpy().astype(np.int64))
    tf = tf.flatten().to_numpy()
    doc = np.repeat(np.arange(len(n)), np.diff(off))
    own = np.flatnonzero(rank >= 0)
    own = own[np.lexsort((rank[own], doc[own]))]
    rank, tf, doc = rank[own], tf[own], doc[own]
    size = np.bincount(doc, minlength=len(n))
    m = norm(n, docs, length)
    band = np.where(size > 0, np.log2(m.astype(float)).astype(np.int64), -1)
    keys = rows.column("c0").to_pylist()
    for c in np.unique(band[band >= 0]):
        at = np.flatnonzero(band == c)
        start = np.cumsum(size) - size
        part = np.arange(size[at].sum()) + np.repeat(start[at] - (np.cumsum(size[at]) - size[at]), size[at])
        own_keys = [keys[i] for i in at]
        orders = [(key is None, key) for key in own_keys]
        trie = Trie(np.concatenate(([0], np.cumsum(size[at]))), rank[part], tf[part], m[at])
        search_trie(trie, items, best, own_keys, orders)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", k: int = 10, item_group: int = ITEM_GROUP) -> DataFrame:
    """``item_key``, list, rank, ``key``, score: the k best documents of each item.

    ``list`` numbers the different texts of one item id from 0; only items are collected, in
    groups of ``item_group``.
    """
    spark = docs.sparkSession
    key_kind, item_kind = docs.schema[key].dataType, items.schema[item_key].dataType
    given = (items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
             .where("text is not null").distinct())
    number = Window.partitionBy("item").orderBy("text")
    given = given.withColumn("list", F.row_number().over(number).cast("long") - 1)
    rows = sorted(given.collect(), key=lambda r: (r["item"] is None, r["item"], r["list"]))
    parsed = [(r["item"], r["list"], terms_of_text(r["text"])) for r in rows]
    empty = (T.StructType().add("item", item_kind).add("list", "long").add("rank", "integer").add("key", key_kind)
             .add("score", "long"))
    vocabulary = sorted({t for *_, terms in parsed for t in terms})
    found = spark.createDataFrame([], empty)
    if vocabulary:
        of = {t: i for i, t in enumerate(vocabulary)}
        shape = (T.StructType().add("key", key_kind).add("n", "long").add("terms", T.ArrayType(T.IntegerType()))
                 .add("tf", T.ArrayType(T.LongType())))
        kept = map_in_arrow(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")),
                            _vectors(spark.sparkContext.broadcast(Vocabulary(vocabulary))), shape)
        kept = materialise(kept, "term-vectors")
        total, length = kept.agg(F.count("*"), F.sum("n")).first()
        df = {r[0]: r[1] for r in kept.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
        for at in range(0, len(parsed) if total else 0, item_group):
            group = parsed[at:at + item_group]
            numbers = [[of[t] for t in terms] for *_, terms in group]
            own = {t for terms in numbers for t in terms}
            index = Items(numbers, {t: n for t, n in df.items() if t in own}, total)
            out = map_in_arrow(kept, _searcher(spark.sparkContext.broadcast(index), total, length, k,
                                               to_arrow_type(key_kind)),
                               T.StructType().add("number", "long").add("key", key_kind).add("score", "long"))
            found = found.unionByName(_merged(out, group, empty, k))
    return (found.withColumnRenamed("key", "_key").withColumnRenamed("item", item_key)
            .withColumnRenamed("_key", key).select(item_key, "list", "rank", key, "score"))


def _merged(out: DataFrame, group: list, shape: T.StructType, k: int) -> DataFrame:
    """The best k of all tasks: first within slices of the tasks, then over the slices."""
    order = [F.desc("score"), F.asc_nulls_last("key")]
    out = out.withColumn("slice", F.spark_partition_id() % 64)
    first = Window.partitionBy("number", "slice").orderBy(*order)
    out = out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order)))
    names = out.sparkSession.createDataFrame([(i, g[0], g[1]) for i, g in enumerate(group)], T.StructType()
                                             .add("number", "long").add(shape["item"].name, shape["item"].dataType)
                                             .add("list", "long"))
    return out.where(F.col("rank") <= k).join(names, "number").select(*[F.col(f.name) for f in shape])


#: The contract of op13 in DuckDB SQL.
SQL = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts
  FROM documents),
docs AS MATERIALIZED (SELECT row, doc_id, len(ts) AS n, ts FROM lowered WHERE len(ts) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t
  FROM benchmark),
wanted AS MATERIALIZED (SELECT item_id, t, count(*) AS times FROM item_terms GROUP BY ALL),
places AS (SELECT row, unnest(ts) AS t FROM docs),
tf AS MATERIALIZED (
  SELECT row, t, count(*) AS tf FROM places SEMI JOIN wanted USING (t) GROUP BY ALL),
weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, totals GROUP BY t, n_docs),
scores AS (
  SELECT item_id, doc_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))
         ))::BIGINT AS score
  FROM wanted JOIN weights USING (t) JOIN tf USING (t) JOIN docs USING (row), totals
  GROUP BY item_id, doc_id, row)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
