"""Repeated passages: fixed-block anchors, extended to maximal exact repeats and removed.

A window is ``WINDOW`` (13) consecutive words of one document. Any window holds exactly one
aligned block of ``BLOCK`` (7) words, a block that starts at a multiple of 7, whole. So:

1. Index and probe. Every document contributes its aligned blocks (the index) and every
   rolling block of 7 words (the probes). Hashes are dealt over partitions by their value. A
   probe hits where its block also occurs in another document; the hit is anchored where an
   indexed block is among them.
2. Extend. Neighbouring hits of a document join to runs. A window in such a run, with an
   anchored block in it, is a candidate; the seven blocks in it identify its 13 words.
3. Decide. For each candidate window the smallest document id that has it is found; the window
   is flagged in all documents with a larger id. Overlapping flagged windows merge to the
   maximal repeats, whose words are removed.

Nothing is sampled or capped, and no pairs of documents are made. Rows travel as packed arrays,
one for each slice of text (``SLICE_BYTES``) and partition. A block that several documents of
one slice share sends one entry to its partition (its places become candidates at once), and a
window sends only the places of the slice's smallest document: so a passage that is in a third
of all documents costs its partition one entry per slice. The text itself moves once, at the
end, to meet its spans.

Identity is by hash: a block by 32 bits within its partition, a window by 64 bits over its
seven blocks.

Defined results: a null text has no words; texts under 13 words lose nothing; rows that repeat
an id are never older than each other; rows with a null id neither remove nor lose words; empty
tables give no rows. Words are runs of characters other than the six ASCII spaces, unchanged.
Extra columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import batch_of, free_name, map_in_arrow, shuffle_parts
from ._text import mix, of_text, positions, slices, utf8, word_hashes, word_spans

WINDOW, BLOCK = 13, 7
SLICE_BYTES = 6 << 20
#: Rows between the stages: where they go, what they are, of which slice, packed arrays.
ROW = "dest int, kind int, slice long, payload binary"
TABLE, FOUND, ASK = 0, 1, 2


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each with its type and length, compressed."""
    import zstandard

    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        out += [struct.pack("<cQ", a.dtype.char.encode(), len(a)), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1
    for _ in range(raw[0]):
        kind, n = struct.unpack_from("<cQ", raw, at)
        dtype = np.dtype(kind.decode())
        out.append(np.frombuffer(raw, dtype, n, at + 9))
        at += 9 + n * dtype.itemsize
    return out


def _gaps(at: np.ndarray) -> np.ndarray:
    return np.diff(at, prepend=0).astype(np.uint32)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in
         enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["dest", "kind", "slice", "payload"])


def _dealt(part: np.ndarray, n_parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, its items in their order)."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(n_parts + 1))
    for p in range(n_parts):
        if ends[p + 1] > ends[p]:
            yield p, order[ends[p]:ends[p + 1]]


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def block_rows(ids: np.ndarray, ties: np.ndarray, texts: pa.Array, name: int, n_parts: int) -> list[tuple]:
    """What one slice sends: its table of documents, places found at once, and its questions."""
    data, off = utf8(texts)
    starts, ends, first = word_spans(data, off)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    use = n >= WINDOW
    counts = np.where(use, n - BLOCK + 1, 0)
    off7 = np.concatenate(([0], np.cumsum(counts)))
    if off7[-1] == 0:
        return []
    at = positions(first, off7)
    h = words[at]
    for j in range(1, BLOCK):
        h = mix(h) + words[at + j]
    h = mix(h)
    doc = of_text(off7)
    aligned = (np.arange(off7[-1]) - off7[:-1][doc]) % BLOCK == 0
    order = np.argsort(h, kind="stable")
    run = _runs(h[order])
    last = np.append(run[1:], len(h)) - 1
    shared = doc[order[run]] != doc[order[last]]      # in several documents of this slice
    anchored = np.maximum.reduceat(aligned[order], run)
    size = np.diff(np.append(run, len(h)))
    in_shared = np.repeat(shared, size)
    now = np.sort(order[in_shared])
    ask = np.sort(np.concatenate((order[~in_shared], order[run[shared]])))
    aligned[order[run[shared]]] = anchored[shared]
    part = ((h >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int32)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = [(name % n_parts, TABLE, name, _pack(ids[use], ties[use], n[use]))]
    if len(now):
        out.append((name % n_parts, FOUND, name, _pack(
            _gaps(now), np.ones(len(now), np.uint8), low[now], part[now].astype(np.uint32))))
    for p, mine in _dealt(part[ask], n_parts):
        places = ask[mine]
        out.append((p, ASK, name, _pack(_gaps(places), aligned[places].astype(np.uint8), low[places])))
    return out


def _map_blocks(n_parts: int, slice_bytes: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for whole in it:
            for b in slices(whole, "text", slice_bytes):
                rows = block_rows(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2),
                                  (task << 32) + k, n_parts)
                k += 1
                if rows:
                    yield _rows(rows)

    return run


def _split(t: pa.Table) -> tuple[list[tuple], list[tuple]]:
    """Rows that pass through, and questions."""
    rows = list(zip(*(t.column(c).to_pylist() for c in ("dest", "kind", "slice", "payload"))))
    return [r for r in rows if r[1] != ASK], [r for r in rows if r[1] == ASK]


def answer_blocks(t: pa.Table) -> pa.Table:
    """One partition of the index: the places whose block another slice has too."""
    out, asked = _split(t)
    if len(asked) > 1:
        asked.sort(key=lambda r: r[2])
        got = [_unpack(r[3]) for r in asked]
        low = np.concatenate([g[2] for g in got])
        aligned = np.concatenate([g[1] for g in got])
        source = np.repeat(np.arange(len(got)), [len(g[2]) for g in got])
        order = np.argsort(low, kind="stable")
        run = _runs(low[order])
        last = np.append(run[1:], len(low)) - 1
        several = source[order[run]] != source[order[last]]
        anchored = np.maximum.reduceat(aligned[order], run)
        size = np.diff(np.append(run, len(low)))
        hit = np.zeros(len(low), bool)
        hit[order] = np.repeat(several, size)
        flag = np.zeros(len(low), np.uint8)
        flag[order] = np.repeat(anchored, size)
        begin = 0
        for r, g in zip(asked, got):
            end = begin + len(g[2])
            mine = np.flatnonzero(hit[begin:end])
            if len(mine):
                out.append((r[0], FOUND, r[2], _pack(
                    _gaps(np.cumsum(g[0])[mine]), flag[begin:end][mine], g[2][mine],
                    np.full(len(mine), r[0], np.uint32))))
            begin = end
    return pa.Table.from_batches([_rows(out)])


def window_rows(t: pa.Table, n_parts: int) -> list[tuple]:
    """One slice: its hits extended to candidate windows; what is known at once; questions."""
    rows, _ = _split(t)
    head = next(r for r in rows if r[1] == TABLE)
    name = head[2]
    ids, _, n = _unpack(head[3])
    off7 = np.concatenate(([0], np.cumsum(n - BLOCK + 1)))
    block = np.zeros(off7[-1], np.uint64)
    known, anchor = np.zeros(off7[-1], bool), np.zeros(off7[-1], bool)
    for r in rows:
        if r[1] == FOUND:
            gaps, flag, low, part = _unpack(r[3])
            at = np.cumsum(gaps, dtype=np.int64)
            block[at] = mix((part.astype(np.uint64) << np.uint64(32)) | low)
            known[at] = True
            anchor[at] |= flag.astype(bool)
    out = [(name % n_parts, TABLE, name, head[3])]
    off13 = np.concatenate(([0], np.cumsum(n - WINDOW + 1)))
    at = positions(off7, off13)
    doc = of_text(off13)
    span = WINDOW - BLOCK + 1
    total = lambda x: np.concatenate(([0], np.cumsum(x)))
    hits, marks = total(known), total(anchor)
    w = np.flatnonzero((hits[at + span] - hits[at] == span) & (marks[at + span] > marks[at]))
    if not len(w):
        return out
    at, doc_id = at[w], ids[doc[w]]
    key = block[at]
    for j in range(1, span):
        key = mix(key) + block[at + j]
    key = mix(key)
    order = np.lexsort((doc_id, key))
    run = _runs(key[order])
    least = np.repeat(doc_id[order[run]], np.diff(np.append(run, len(key))))
    later = np.zeros(len(key), bool)
    later[order] = doc_id[order] > least
    if later.any():
        out.append((name % n_parts, FOUND, name, _pack(_gaps(w[later]))))
    ask = np.flatnonzero(~later)
    part = ((key[ask] >> np.uint64(33)) % np.uint64(n_parts)).astype(np.int32)
    for p, mine in _dealt(part, n_parts):
        i = ask[mine]
        out.append((p, ASK, name, _pack(_gaps(w[i]), key[i], doc_id[i])))
    return out


def answer_windows(t: pa.Table) -> pa.Table:
    """One partition of windows: the places whose window a document of a smaller id has."""
    out, asked = _split(t)
    if len(asked) > 1:
        got = [_unpack(r[3]) for r in asked]
        key, doc_id = (np.concatenate([g[i] for g in got]) for i in (1, 2))
        order = np.lexsort((doc_id, key))
        run = _runs(key[order])
        least = np.repeat(doc_id[order[run]], np.diff(np.append(run, len(key))))
        later = np.zeros(len(key), bool)
        later[order] = doc_id[order] > least
        begin = 0
        for r, g in zip(asked, got):
            end = begin + len(g[1])
            mine = np.flatnonzero(later[begin:end])
            if len(mine):
                out.append((r[0], FOUND, r[2], _pack(_gaps(np.cumsum(g[0], dtype=np.int64)[mine]))))
            begin = end
    return pa.Table.from_batches([_rows(out)])


def spans_of(t: pa.Table) -> pa.Table:
    """One slice: the repeats of its documents, as (first word, words) pairs."""
    rows, _ = _split(t)
    ids, ties, n = _unpack(next(r for r in rows if r[1] == TABLE)[3])
    first = np.concatenate(([0], np.cumsum(n)))
    off13 = np.concatenate(([0], np.cumsum(n - WINDOW + 1)))
    change = np.zeros(first[-1] + 1, np.int32)
    for r in rows:
        if r[1] == FOUND:
            w = np.cumsum(_unpack(r[3])[0], dtype=np.int64)
            doc = np.searchsorted(off13, w, side="right") - 1
            at = w - off13[doc] + first[doc]
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
    gone = np.cumsum(change[:-1]) > 0
    doc = of_text(first)
    new = gone.copy()
    new[1:] &= ~(gone[:-1] & (doc[1:] == doc[:-1]))
    begin = np.flatnonzero(new)
    stop = gone.copy()
    stop[:-1] &= ~(gone[1:] & (doc[1:] == doc[:-1]))
    length = np.flatnonzero(stop) + 1 - begin
    of = doc[begin]
    use, at = np.unique(of, return_index=True)
    off = np.append(at, len(of)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x.astype(np.int64)))
             for x in (begin - first[of], length)]
    return pa.table([pa.array(ids[use]), pa.array(ties[use]), *lists], names=["id", "tie", "first", "words"])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
            slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """id, tie (hash of the text), first, words: the maximal repeats of every document that has
    some, as word positions and lengths; once for rows of the same id and text."""
    parts = shuffle_parts(docs.sparkSession)
    rows = (docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
            .select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text")))

    def windows(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows(window_rows(t, parts))])

    return (rows.mapInArrow(_map_blocks(parts, slice_bytes), ROW)
            .groupBy("dest").applyInArrow(answer_blocks, ROW)
            .groupBy("slice").applyInArrow(windows, ROW)
            .groupBy("dest").applyInArrow(answer_windows, ROW)
            .groupBy("slice").applyInArrow(spans_of, "id long, tie long, first array<long>, words array<long>")
            .dropDuplicates(["id", "tie"]))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """All rows and columns, and n_words, n_removed, kept_text (kept words, one space between).

    Columns of the input with these names are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    names = {c: free_name(docs, f"_{c}") for c in ("id", "tie", "first", "words")}
    found = repeats(docs, key, text, slice_bytes).withColumnsRenamed(names)
    rows = docs.join(found, (docs[key].cast("long") == found[names["id"]])
                     & (F.xxhash64(docs[text]) == found[names["tie"]]), "left").drop(names["id"], names["tie"])
    at = docs.columns.index(text)
    n = len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, whole.schema.names[at]):
                data, off = utf8(b.column(at))
                raw = data.tobytes()
                total, removed, kept = [], [], []
                for i in range(b.num_rows):
                    words = raw[off[i]:off[i + 1]].split()
                    total.append(len(words))
                    gone = 0
                    if b.column(n)[i].is_valid:
                        left, end = [], 0
                        for f, k in zip(b.column(n)[i].as_py(), b.column(n + 1)[i].as_py()):
                            left += words[end:f]
                            end, gone = f + k, gone + k
                        words = left + words[end:]
                    removed.append(gone)
                    kept.append(b" ".join(words))
                yield batch_of([*b.columns[:n], pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                pa.array(kept, pa.binary()).cast(pa.string())])

    return map_in_arrow(rows, cut, schema)


def digest(docs: DataFrame) -> DataFrame:
    return (remove_repeats(docs.select("doc_id", "text"))
            .select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")))


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
p AS (
  SELECT doc_id, i, words[i + 1:i + 13] AS win FROM (
    SELECT doc_id, words, unnest(range(0, len(words) - 12)) AS i FROM w WHERE len(words) >= 13 AND doc_id IS NOT NULL)),
f AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS m FROM p) WHERE doc_id > m),
g AS (
  SELECT DISTINCT doc_id, i + j AS k FROM f, (SELECT unnest(range(0, 13)) AS j)),
r AS (
  SELECT doc_id, count(*) AS n_removed, list(k) AS ks FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN words
    ELSE list_filter(words, lambda x, i: NOT list_contains(ks, i - 1)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""
