"""Near duplicates: consistent weighted sampling of TF-IDF word shingles, banded and verified.

1. Document frequencies of the five-word shingles of all documents are counted in a count-min
   sketch (two rows of 65,536 counters, the same size for any corpus). It yields the relative
   frequency f of a shingle with an error that does not grow with the corpus, and from it the
   weight tf * idf: tf = 1 + ln(count), idf = ln(1 / (f + F0)) / ln(1 / F0), not under
   ``IDF_FLOOR`` (so that the shared text of a very large group of copies keeps its say).
2. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples (shingle, level) from
   each weighted set; two sets agree on a sample with probability equal to their weighted
   Jaccard similarity. Its random variables come from tables addressed by shingle hash bits.
3. Samples are banded. Inside a bucket (at most ``BLOCK`` rows to a task, more are split into
   blocks whose leaders are compared block by block), leaders are picked in the order of nodes: a
   row whose samples agree enough with an earlier leader is paired with it, else it leads itself.
   Exact copies (by text hash and signature) are linked to the first of them, and only that one
   is in buckets.
4. A pair is dropped if the weights of both rows by ``HIST`` parts of the shingles' hashes don't
   allow the threshold (they never give less than the similarity). Every other pair is verified
   on whole texts by exact weighted Jaccard similarity; a leader's pairs are split into salted
   groups with a copy of the leader in each.
5. The classes so far are found. Rows of a bucket that are in different classes meet in rounds:
   a pair counts if its samples agree enough, if it was not tested, and if the parts allow the
   threshold. In the first round a row asks its best partner in each of a few classes,
   the answers are verified and classes joined; the next asks more (``ASK``), the last all that
   is left. So no link is lost, and rows that are linked already, or can't be, cost no test.
6. Verified pairs form classes (connected components by alternating stars). A class is named
   by its smallest document id.

With 36 samples in 12 bands of 3, a pair at similarity 0.8 meets in a bucket with probability
0.9998. Comparing the parts is done inside the tasks, block by block; what is written and
verified are the asked pairs only.

Words are runs of characters other than the ASCII spaces. Defined results: a text of fewer
than five words is one shingle; a null text or one without words is alone in its class; rows
with the same id and text are one node and share the class; a null id is kept, and names a
class only where no other id is in it (as null). Extra columns are ignored by ``classes`` and
kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import every_column, free_name, materialise
from ._text import mix, of_text, rolling, slices, utf8, word_hashes, word_spans

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
AGREE = 20                       # of 36 samples: far below what a similarity of 0.8 gives
BLOCK = 4096
MEET = 1024                      # rows of each side of a later meeting: at most a million pairs
HIST = 128
ASK = ((16, 2), (1 << 62, 1 << 62))   # partners of a row, and those of one class, by round
SALT_ROWS = 256
SKETCH_BITS = 16
F0, IDF_FLOOR = 0.02, 0.8
_TABLE_BITS = 13


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (sorted by text, then hash), their counts, and offsets."""
    data, off = utf8(column)
    starts, ends, first = word_spans(data, off)
    words = word_hashes(data, starts, ends)
    grams, goff = rolling(words, first, SHINGLE)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    text = of_text(goff)
    if len(short):
        extra = [rolling(words[first[i]:first[i + 1]], np.array([0, n[i]]), int(n[i]))[0][0] for i in short]
        grams = np.concatenate((grams, np.array(extra, np.uint64)))
        text = np.concatenate((text, short))
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(grams)))
    return grams[at], counts, np.searchsorted(text[at], np.arange(len(off)))


def _sketch_rows(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = np.uint64((1 << SKETCH_BITS) - 1)
    return (grams & width).astype(np.int64), ((grams >> np.uint64(24)) & width).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """The sketch (2 x 65,536 counters) and the number of documents, over all documents."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((2, 1 << SKETCH_BITS), np.int64), 0
        for whole in it:
            for b in slices(whole, "text"):
                grams, _, _ = shingle_sets(b.column(0))
                for i, at in enumerate(_sketch_rows(grams)):
                    total[i] += np.bincount(at, minlength=1 << SKETCH_BITS)
                rows += b.num_rows
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)),
                                          pa.array(np.append(flat[at], rows))], names=["at", "n"])

    got = (docs.select(F.col(text).alias("text")).mapInArrow(count, "at int, n long")
           .groupBy("at").agg(F.sum("n").alias("n")).toArrow())
    at, n = got.column("at").to_numpy(), got.column("n").to_numpy()
    sketch = np.zeros(2 << SKETCH_BITS, np.int64)
    sketch[at[at >= 0]] = n[at >= 0]
    return sketch.reshape(2, -1), int(n[at < 0].sum())


class Weights:
    """TF-IDF weights from the sketch."""

    def __init__(self, sketch: np.ndarray, documents: int):
        f = sketch / max(1, documents)
        self.f = f.astype(np.float32)

    def __call__(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        a, b = _sketch_rows(grams)
        f = np.minimum(self.f[0][a], self.f[1][b])
        idf = np.maximum(np.log(1 / (f + np.float32(F0))) / np.float32(np.log(1 / F0)), np.float32(IDF_FLOOR))
        return (idf * (1 + np.log(counts.astype(np.float32)))).astype(np.float32)


_tables: list[np.ndarray] = []


def _random_tables() -> list[np.ndarray]:
    if not _tables:
        rng = np.random.default_rng(20240229)
        n = 1 << _TABLE_BITS
        r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        _tables[:] = [r, (1 / r).astype(np.float32),
                      np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32), rng.random(n).astype(np.float32)]
    return _tables


def samples(grams: np.ndarray, weights: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts with shingles, SAMPLES) consistent weighted samples, as 64-bit hashes.

    For sample j and shingle k with weight w: t = floor(ln w / r + beta), ln y = r (t - beta),
    ln a = ln c - ln y - r; the sample is the (k, t) with the least a.
    """
    r_table, inv_table, c_table, b_table = _random_tables()
    full = np.flatnonzero(np.diff(off))
    start = off[full]
    size = np.diff(np.append(start, len(grams)))
    log_w = np.log(weights)
    mask = np.uint64((1 << _TABLE_BITS) - 1)
    out = np.empty((len(full), SAMPLES), np.uint64)
    for j in range(SAMPLES):
        z = grams * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & ((1 << 64) - 1))
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        ri = ((z >> np.uint64(51)) & mask).astype(np.int32)
        r = r_table[ri]
        beta = b_table[((z >> np.uint64(38)) & mask).astype(np.int32)]
        t = np.floor(log_w * inv_table[ri] + beta)
        ln_a = c_table[((z >> np.uint64(25)) & mask).astype(np.int32)] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(ln_a, start)
        hit = np.flatnonzero(ln_a == np.repeat(least, size))
        text = np.searchsorted(start, hit, side="right") - 1
        first = np.ones(len(hit), bool)
        first[1:] = text[1:] != text[:-1]
        hit = hit[first]
        out[:, j] = mix(grams[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def parts_of(grams: np.ndarray, weights: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Of each text with shingles: its weight, a unit, and its weight in each of HIST parts of the
    hashes in units, rounded up to a byte. The shared weight of two texts is at most the sum of
    the lesser part of each two."""
    full = np.flatnonzero(np.diff(off))
    text = np.repeat(np.arange(len(full)), np.diff(off)[full])
    part = ((grams >> np.uint64(37)) % np.uint64(HIST)).astype(np.int64)
    own = np.bincount(text * HIST + part, weights, len(full) * HIST).reshape(-1, HIST)
    unit = (own.max(axis=1) / 255 * 1.0001).astype(np.float32)
    head = np.column_stack((own.sum(axis=1).astype(np.float32), unit)).astype("<f4")
    steps = np.minimum(np.ceil(own / unit[:, None]), 255).astype(np.uint8)
    return [h.tobytes() + q.tobytes() for h, q in zip(head, steps)]


def _parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Total weights and weights by part, back from bytes."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 8 + HIST)
    head = np.ascontiguousarray(raw[:, :8]).view("<f4")
    return head[:, 0], raw[:, 8:].astype(np.float32) * head[:, 1:]


def node_of(key: str, text: str):
    """One node for rows with the same id and text."""
    return F.xxhash64(F.col(key), F.col(text), F.lit("node"))


def _signatures(docs: DataFrame, key: str, text: str, weights) -> DataFrame:
    """One row for each node with words: node, id, copy (text hash), sig (one byte per sample), bands
    (bucket keys), parts (see ``parts_of``). Rows with the same id and text are one node."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for whole in it:
            for b in slices(whole, "text", 1 << 20):
                grams, counts, off = shingle_sets(b.column(3))
                if not len(grams):
                    continue
                weight = w(grams, counts)
                s = samples(grams, weight, off)
                bands = np.stack([s[:, i * ROWS] * np.uint64(3) + s[:, i * ROWS + 1] * np.uint64(5)
                                  + s[:, i * ROWS + 2] * np.uint64(7) + np.uint64(i) for i in range(BANDS)], axis=1)
                bands = mix(bands).astype(np.int64)
                at = pa.array(np.flatnonzero(np.diff(off)))
                n = len(s)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at),
                     pa.array([x.tobytes() for x in (s & np.uint64(255)).astype(np.uint8)], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS),
                                              pa.array(bands.ravel())),
                     pa.array(parts_of(grams, weight, off), pa.binary())],
                    names=["node", "id", "copy", "sig", "bands", "parts"])

    kind = docs.schema[key].dataType.simpleString()
    every = (docs.select(node_of(key, text).alias("node"), F.col(key).alias("id"),
                         F.xxhash64(F.col(text), F.lit("copy")).alias("copy"), F.col(text).alias("text"))
             .mapInArrow(run, f"node long, id {kind}, copy long, sig binary, bands array<long>, parts binary"))
    return every.dropDuplicates(["node"])             # partial on every task, whatever repeats


def _copies(sig: DataFrame) -> DataFrame:
    """node, leader: each node of a text that several nodes have, with the first of them.

    Texts are equal by hash and signature; copies need no meeting and no verification.
    """
    first = (sig.groupBy("copy", "sig").agg(F.min(F.struct("id", "node"))["node"].alias("leader"),
                                            F.min("node").alias("low"), F.max("node").alias("high"))
             .where("low <> high").select("copy", "sig", "leader"))
    first = materialise(first, "neardup-copied")
    return sig.select("node", "copy", "sig").join(first, ["copy", "sig"]).where("node <> leader").select("node", "leader").distinct()


def _lead(nodes: np.ndarray, sig: np.ndarray) -> tuple[list, list, list]:
    """Pairs (row, leader) and the leaders, of rows in their order."""
    members, of, leaders = [], [], []
    free = np.ones(len(nodes), bool)
    for i in range(len(nodes)):
        if not free[i]:
            continue
        leaders.append(i)
        like = np.flatnonzero((sig[i + 1:] == sig[i]).sum(1) >= AGREE) + i + 1
        free[like] = False
        members.append(nodes[like])
        of.append(np.full(len(like), nodes[i]))
    return members, of, leaders


def _sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SAMPLES)


_PAIR = pa.schema([("node", pa.int64()), ("leader", pa.int64()), ("sig", pa.binary())])


def _by_leaders(t: pa.Table) -> pa.Table:
    """Candidate pairs of one block of one bucket, and its leaders (leader null, with sig)."""
    t = t.sort_by("node")
    nodes = t.column("node").to_numpy()
    members, of, leaders = _lead(nodes, _sig_matrix(t.column("sig")))
    m, o = np.concatenate(members), np.concatenate(of)
    pairs = pa.table([pa.array(m), pa.array(o), pa.nulls(len(m), pa.binary())], schema=_PAIR)
    if not t.column("split")[0].as_py():
        return _blocked(pairs, t, 0)
    lead = pa.array(leaders)
    own = pa.table([pa.array(nodes[leaders]), pa.nulls(len(leaders), pa.int64()),
                    t.column("sig").combine_chunks().take(lead) if isinstance(t.column("sig"), pa.ChunkedArray)
                    else t.column("sig").take(lead)], schema=_PAIR)
    return _blocked(pa.concat_tables([pairs, own]), t, 1)


def _blocked(out: pa.Table, t: pa.Table, more: int) -> pa.Table:
    n = out.num_rows
    return (out.append_column("key", pa.array(np.full(n, t.column("key")[0].as_py(), np.int64)))
            .append_column("block", pa.array(np.full(n, t.column("block")[0].as_py(), np.int32)))
            .append_column("blocks", pa.array(np.full(n, t.column("blocks")[0].as_py(), np.int32))))


def _between_blocks(t: pa.Table) -> pa.Table:
    """Pairs of like leaders of two blocks of one bucket (``side`` 0 and 1)."""
    side = t.column("side").to_numpy()
    nodes, sig = t.column("node").to_numpy(), _sig_matrix(t.column("sig"))
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    m, o = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in a:
        like = b[(sig[b] == sig[i]).sum(1) >= AGREE]
        m.append(nodes[like])
        o.append(np.full(len(like), nodes[i]))
    return pa.table([pa.array(np.concatenate(m)), pa.array(np.concatenate(o))], names=["node", "leader"])


def _bucket_rows(sig: DataFrame) -> DataFrame:
    """The rows of all buckets of several rows, each bucket in blocks of about BLOCK rows."""
    rows = sig.select("node", "sig", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialise(sizes, "neardup-buckets")
    return (rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("split", F.col("blocks") > 1)
            .select("key", "block", "blocks", "split", "node", "sig"))


def _once(pairs: DataFrame) -> DataFrame:
    """x < y of each pair, once, with its node and leader."""
    return (pairs.where("node <> leader")
            .select(F.least("node", "leader").alias("x"), F.greatest("node", "leader").alias("y"), "node", "leader")
            .dropDuplicates(["x", "y"]))


def _candidates(inside: DataFrame) -> DataFrame:
    """The pairs of rows and leaders to verify, each once."""
    found = materialise(inside.groupBy("key", "block").applyInArrow(
        _by_leaders, "node long, leader long, sig binary, key long, block int, blocks int"), "neardup-leaders")
    pairs = found.where("leader is not null").select("node", "leader")
    # leaders of buckets in several blocks: every two blocks of a bucket meet once
    lead = found.where("leader is null")
    pick = lambda side: lead.select(
        "key", "node", "sig", F.lit(side).alias("side"),
        F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"), "block")
    low, high = F.col("block"), F.col("other")
    meet = (pick(0).where(low < high).select("key", low.alias("a"), high.alias("b"), "node", "sig", "side")
            .unionByName(pick(1).where(low > high).select("key", high.alias("a"), low.alias("b"), "node", "sig", "side")))
    across = meet.groupBy("key", "a", "b").applyInArrow(_between_blocks, "node long, leader long")
    return _once(pairs.unionAll(across))


def _asker(similarity: float, most: int, of_class: int):
    """Pairs of different classes to verify: rows outside a bucket's largest class ask others."""
    def run(t: pa.Table) -> pa.Table:
        guest = t.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        major = t.column("major").to_numpy(zero_copy_only=False).astype(bool)
        nodes, of, sig = t.column("node").to_numpy(), t.column("class").to_numpy(), _sig_matrix(t.column("sig"))
        total, part = _parts(t.column("parts"))
        asked = t.column("asked").to_pylist()
        b = np.flatnonzero(~guest)
        m, o = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own, own_of, own_sig, own_major, own_part, own_total = nodes[b], of[b], sig[b], major[b], part[b], total[b]
        for i in np.flatnonzero(guest):
            # two guests meet twice: once is enough
            at = np.flatnonzero((own_of != of[i]) & (own_major | (own < nodes[i])))
            at = at[(own_sig[at] == sig[i]).sum(1) >= AGREE]
            shared = np.minimum(own_part[at], part[i]).sum(axis=1)
            bound = shared / np.maximum(own_total[at] + total[i] - shared, 1e-9)
            like = bound >= similarity - 1e-3
            at, bound = at[like], bound[like]
            if len(at) and asked[i]:
                new = ~np.isin(own[at], asked[i])
                at, bound = at[new], bound[new]
            if not len(at):
                continue
            known = [j for j in range(len(at)) if asked[b[at[j]]] is not None and nodes[i] in asked[b[at[j]]]]
            at, bound = np.delete(at, known), np.delete(bound, known)
            order = np.lexsort((own[at], -bound, own_of[at]))     # the best of each class first
            classes = own_of[at][order]
            place = np.arange(len(order)) - np.searchsorted(classes, classes)
            order = order[place < of_class]
            order = order[np.argsort(-bound[order], kind="stable")][:most]
            got = own[at][order]
            m.append(np.full(len(got), nodes[i]))
            o.append(got)
        return pa.table([pa.array(np.concatenate(m)), pa.array(np.concatenate(o))], names=["node", "leader"])

    return run


def _later_candidates(inside: DataFrame, sig: DataFrame, tested: DataFrame, found: DataFrame, similarity: float,
                      ask: tuple[int, int]) -> DataFrame:
    """Pairs of rows of a bucket that are in different classes (``found``: node, component), were
    not tested and may be similar: of each row at most ``ask`` partners (in all, in a class).

    Buckets of two rows have met whole. The rows of a bucket's largest class need not meet each
    other; the others go to each block of MEET rows, in groups of MEET rows. After the last round
    every like pair of a bucket is tested, in one class, or can't reach the threshold.
    """
    rows = inside.select("key", "node").join(found, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("class"))
    of_class = rows.groupBy("key", "class").agg(F.count("*").alias("n"))
    open_ = materialise(of_class.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("top"))
                        .where("n > 2 and top.n < n")
                        .select("key", F.col("top.class").alias("largest"),
                                F.ceil(F.col("n") / MEET).cast("int").alias("blocks"),
                                F.ceil((F.col("n") - F.col("top.n")) / MEET).cast("int").alias("groups")),
                        "neardup-open-buckets")
    rows = materialise(rows.join(open_, "key").withColumn("major", F.col("class") == F.col("largest")), "neardup-open")
    # whom a row was paired with as the member of a pair: a leader a bucket, and whom it asked
    asked = tested.groupBy("node").agg(F.collect_set("leader").alias("asked"))
    marks = (sig.select("node", "sig", "parts").join(rows.select("node").distinct(), "node").join(asked, "node", "left"))
    rows = rows.join(materialise(marks, "neardup-marks"), "node")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    carried = ["node", "sig", "parts", "asked", "class", "major"]
    own = rows.select("key", part("blocks").alias("a"), every("groups").alias("b"), *carried, F.lit(False).alias("guest"))
    guests = rows.where(~F.col("major")).select("key", every("blocks").alias("a"), part("groups").alias("b"), *carried,
                                                F.lit(True).alias("guest"))
    met = own.unionAll(guests).groupBy("key", "a", "b").applyInArrow(_asker(similarity, *ask), "node long, leader long")
    return _once(met).join(tested.select("x", "y"), ["x", "y"], "left_anti")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least weights over sum of largest weights; shingles sorted in each set."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum()) + float(b[1].sum()) - shared
    return shared / total if total else 0.0


def _possible(pairs: DataFrame, sig: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, leader) whose weights by parts allow the threshold."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                (x, own), (y, other) = _parts(b.column(2)), _parts(b.column(3))
                shared = np.minimum(own, other).sum(axis=1)
                like = shared / np.maximum(x + y - shared, 1e-9) >= similarity - 1e-3
                yield b.select(["node", "leader"]).filter(pa.array(like))

    own = sig.select("node", F.col("parts").alias("own"))
    other = sig.select(F.col("node").alias("leader"), F.col("parts").alias("other"))
    return (pairs.select("node", "leader").join(own, "node").join(other, "leader").select("node", "leader", "own", "other")
            .mapInArrow(run, "node long, leader long"))


def _verified(docs: DataFrame, pairs: DataFrame, key: str, text: str, weights, similarity: float) -> DataFrame:
    """The pairs (node, leader, similarity) at or above the threshold."""
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    sizes = materialise(pairs.groupBy("leader").agg(F.count("*").alias("n")), "neardup-sizes")
    sized = pairs.join(sizes, "leader").withColumn("salts", salts)
    members = sized.select("node", "leader", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"),
                           F.lit(False).alias("leads"))
    heads = sizes.withColumn("salts", salts).select(
        F.col("leader").alias("node"), "leader", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"),
        F.lit(True).alias("leads"))
    texts = docs.select(node_of(key, text).alias("node"), F.col(text).alias("text"))
    many = materialise(texts.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"),
                       "neardup-repeated-nodes")
    texts = texts.join(many, "node", "left_anti").unionAll(
        texts.join(many, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")))
    rows = texts.join(members.unionAll(heads), "node").select("leader", "salt", "leads", "node", "text")

    def verify(t: pa.Table) -> pa.Table:
        w = weights.value
        leads = t.column("leads").to_pylist()
        nodes, sims = [], []
        head = None
        order = sorted(range(len(leads)), key=lambda i: not leads[i])
        for i in order:
            grams, counts, _ = shingle_sets(t.column("text").slice(i, 1).combine_chunks())
            own = (grams, w(grams, counts))
            if leads[i]:
                head = own
            elif head is not None:
                s = weighted_jaccard(own, head)
                if s >= similarity:
                    nodes.append(t.column("node")[i].as_py())
                    sims.append(s)
        lead = t.column("leader")[0].as_py()
        return pa.table([pa.array(nodes, pa.int64()), pa.array([lead] * len(nodes), pa.int64()),
                         pa.array(sims, pa.float64())], names=["node", "leader", "similarity"])

    return rows.groupBy("leader", "salt").applyInArrow(verify, "node long, leader long, similarity double")


def components(edges: DataFrame, a: str = "node", b: str = "leader") -> DataFrame:
    """node, component: the least node of its connected component, by alternating stars.

    Each round is written to the shared folder; rounds go on until the edges stay the same.
    """
    edges = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                        .where("u <> v").distinct(), "stars")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v")))).where("u <> v").distinct()
        edges = materialise(small, "stars")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
        state = now


def _groups(docs: DataFrame, key: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(all nodes with words: node, id; nodes of classes of several: node, component, links)."""
    sc = docs.sparkSession.sparkContext
    sketch, n = document_frequencies(docs, text)
    weights = sc.broadcast(Weights(sketch, n))        # 2 x 65,536 numbers, whatever the corpus
    sig = materialise(_signatures(docs, key, text, weights), "neardup-signatures")
    copies = materialise(_copies(sig), "neardup-copies")
    inside = _bucket_rows(sig.join(copies.select("node"), "node", "left_anti"))
    pairs = materialise(_candidates(inside), "neardup-pairs")
    likely = materialise(_possible(pairs, sig, similarity), "neardup-likely")
    edges = materialise(_verified(docs, likely, key, text, weights, similarity), "neardup-links")
    for ask in ASK:
        found = materialise(components(edges), "neardup-classes-so-far")
        more = materialise(_later_candidates(inside, sig, pairs, found, similarity, ask), "neardup-asked")
        if more.isEmpty():
            break
        links = _verified(docs, more, key, text, weights, similarity)
        edges = materialise(edges.unionAll(links), "neardup-links")
        pairs = materialise(pairs.unionByName(more), "neardup-tested")
    edges = edges.select("node", "leader").unionAll(copies)
    links = (edges.select("node").unionAll(edges.select(F.col("leader").alias("node")))
             .groupBy("node").agg(F.count("*").alias("links")))
    return sig.select("node", "id"), components(edges).join(links, "node")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text",
            similarity: float = SIMILARITY) -> DataFrame:
    """``key``, class_id (smallest id of the class), class_size, n_links (verified pairs of the
    row) for every row."""
    nodes, grouped = _groups(docs, key, text, similarity)
    named = materialise(nodes.join(grouped, "node").groupBy("component")
                        .agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")), "neardup-names")
    marks = materialise(grouped.join(named, "component").select("node", "class_id", "class_size", "links"),
                        "neardup-classes")
    rows = docs.select(F.col(key), node_of(key, text).alias("node")).join(marks, "node", "left")
    return rows.select(key, F.when(F.col("class_size").isNull(), F.col(key)).otherwise(F.col("class_id")).alias("class_id"),
                       F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                       F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text",
                similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without all but one row (of the smallest id) of each class."""
    nodes, grouped = _groups(docs, key, text, similarity)
    kept = (nodes.join(grouped, "node").groupBy("component")
            .agg(F.min(F.struct(F.col("id").isNull(), "id", "node"))["node"].alias("node")).select("node"))
    # nodes that go: members of classes other than the one kept
    gone = materialise(grouped.select("node").join(kept, "node", "left_anti"), "neardup-gone")
    # rows with the same id and the same text are one document
    mark = free_name(docs, "_node")
    marked = docs.withColumn(mark, node_of(key, text))
    repeated = materialise(marked.groupBy(mark).agg(F.count("*").alias("n")).where("n > 1").select(mark),
                           "neardup-repeated")
    rest = marked.join(gone.withColumnRenamed("node", mark), mark, "left_anti")
    once = rest.join(repeated, mark, "left_anti")
    twice = rest.join(repeated, mark, "left_semi").dropDuplicates([mark])
    return once.unionByName(twice).select(every_column(docs))
