"""Phrase collocations per language: multikey three-way quicksort of suffix pointers.

Texts (A-Z lowered) are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words
``[^\\x20\\x09]+``. A suffix is a word and up to three words that follow it in its piece.

1. Every task counts its equal suffixes and words, so a repeated passage is one line per slice.
2. Suffixes are routed by a hash of their two leading words; the words that a partition is to
   sort travel as text, so no dictionary is shared. Pairs with more suffixes than a bucket is
   to hold (found on a bounded sample, which decides the routing only, never a result) are
   routed by all four words, and their counts added up afterwards.
3. In each bucket suffix pointers are sorted by multikey three-way quicksort to depth four. The
   size of an equal part is the count of its words; any part of fewer than ``least`` suffixes
   is abandoned, with all that is in it.
4. Words with ``least`` occurrences and these phrases are one table, much smaller than the
   corpus; cuts, scores and containment are joins on it.

Scores use integers and decimals only. Words are told apart by their bytes (hashes are
verified). Defined results: null or empty texts have no words; a null language counts as
``und``; repeated rows and ids count as often as they occur; ids and extra columns are ignored;
an empty table gives no rows; long texts are cut into chunks of suffixes, never shortened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._spark import bounded_sample, map_in_arrow, materialise, shuffle_parts
from ._text import mix, slices, stable_order, unique_hashes, utf8, word_hashes

DEPTH = 4
_SLICE = 8 << 20
_CHUNK = 1 << 20
_LINES = 1 << 17                          # written as one batch
_SPELLED = 1 << 18                        # bytes looked up at once
_BYTES_A_WORD = 6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER = _LOWER.tobytes()
_KIND = np.zeros(256, np.uint8)           # 0: of a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_KIND = _KIND.tobytes()


def _places(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Places in ``data``, in half the memory where they fit."""
    return at.astype(np.int32) if len(data) < 1 << 31 else at


def spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given spans one after another (``gap`` free bytes after each) and their offsets."""
    n = ends - starts + gap
    off = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(off[-1], np.uint8)
    i = 0
    while i < len(n):                         # indexes take eight times the bytes they look up
        j = max(i + 1, int(np.searchsorted(off, off[i] + _SPELLED, side="right")) - 1)
        at = np.arange(off[i], off[j]) + np.repeat(starts[i:j] - off[i:j], n[i:j])
        if gap:
            np.minimum(at, max(len(data) - 1, 0), out=at)
        out[off[i]:off[j]] = data[at]
        i = j
    return out, off


def strings(data: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow string or binary array over bytes and offsets."""
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])


def same_bytes(data: np.ndarray, s1: np.ndarray, s2: np.ndarray, n: np.ndarray) -> bool:
    """Whether every span of ``n`` bytes at ``s1`` equals the one at ``s2``."""
    long = n > 64
    for i in np.flatnonzero(long):
        if not np.array_equal(data[s1[i]:s1[i] + n[i]], data[s2[i]:s2[i] + n[i]]):
            return False
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    for i in range(0, len(n), _SPELLED):
        own = ~long[i:i + _SPELLED]
        a, b, left = s1[i:i + _SPELLED][own], s2[i:i + _SPELLED][own], n[i:i + _SPELLED][own]
        while (left > 0).any():
            more = left > 0
            a, b, left = a[more], b[more], left[more]
            beyond = (8 - np.minimum(left, 8)).astype(np.uint64) << np.uint64(3)
            if ((eight[a] ^ eight[b]) << beyond).any():
                return False
            a, b, left = a + 8, b + 8, left - 8
    return True


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the distinct words, one word of each number, and the hash of each number.

    Hashes are checked against the words' bytes; words of one hash that differ (never seen, but
    possible) are numbered by their bytes instead.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes, first, ids = unique_hashes(word_hashes(data, starts, ends))
    n = ends - starts
    if not (np.array_equal(n, n[first][ids]) and same_bytes(data, starts, starts[first][ids], n)):
        own = word_hashes(data, starts, ends)
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(data[s:e].tobytes(), len(known)) for s, e in zip(starts, ends)], np.int64)
        first = np.unique(ids, return_index=True)[1]
        hashes = own[first]
    return ids, first, hashes


def suffixes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, the text number of each, and how many words (at most DEPTH) of
    its piece its suffix has. ``data`` is lowered."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    kind = np.frombuffer(data.tobytes().translate(_KIND), np.uint8)
    word = kind == 0
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
    starts, ends = _places(np.flatnonzero(first), data), _places(np.flatnonzero(last) + 1, data)
    del word, first, last
    text = np.searchsorted(off, starts, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts) + text        # grows with either
    goes_on = np.zeros(len(starts) + DEPTH, bool)
    if len(starts):
        goes_on[:len(starts) - 1] = piece[1:] == piece[:-1]
    length = np.ones(len(starts), np.int64)
    run = np.ones(len(starts), bool)
    for j in range(DEPTH - 1):
        run &= goes_on[j:j + len(starts)]
        length += run
    return starts, ends, text, length


def quicksort(keys: np.ndarray, weight: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal parts of suffix pointers: (a pointer of the part, its depth in words, its weight).

    ``keys``: a row of word numbers for each suffix, 0 behind its end. Multikey three-way
    quicksort: each part is split by its pivot's word at the part's depth; the equal part goes
    on one word deeper, without suffixes that end there. ``least[d]``: parts of less weight
    that differ in word d are abandoned. All parts are split together, round by round.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ptr = np.flatnonzero(keys[:, 0] > 0)
    size, depth = np.array([len(ptr)]), np.zeros(1, np.int64)
    bound = np.array(least, np.float64)
    while len(ptr):
        n = len(size)
        start = np.cumsum(size) - size
        key = keys[ptr, np.repeat(depth, size)]
        a, b, c = key[start], key[start + size // 2], key[start + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        code = np.repeat(np.arange(n) * 3 + 1, size) + np.sign(key - pivot)
        total = np.bincount(code, weight[ptr], 3 * n)
        deep = np.repeat(depth, 3)
        keep = total >= bound[deep]
        count = np.bincount(code, minlength=3 * n)
        order = stable_order(code, 3 * n)
        first = ptr[order[np.minimum(np.cumsum(count) - count, len(ptr) - 1)]]
        equal = np.zeros(3 * n, bool)
        equal[1::3] = keep[1::3]
        out.append((first[equal], deep[equal] + 1, total[equal].astype(np.int64)))
        keep[1::3] &= depth < keys.shape[1] - 1
        deep = deep + (np.arange(3 * n) % 3 == 1)
        keep &= count > 0
        live = keep[code]
        live &= keys[ptr, np.minimum(deep[code], keys.shape[1] - 1)] > 0
        order = order[live[order]]
        ptr = ptr[order]
        count = np.bincount(code[order], minlength=3 * n)
        size, depth = count[count > 0], deep[count > 0]
    return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) + second)


def _sliced(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(language of each text, data, starts, ends, text numbers, suffix lengths) of each slice."""
    for whole in it:
        for b in slices(whole, "c1", _SLICE):
            data, off = utf8(b.column(1))
            data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
            yield b.column(0), data, *suffixes(data, off)


def _count_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c0 language, c1 word, c2 count of each slice."""
    for langs, data, starts, ends, text, _ in _sliced(it):
        if len(starts):
            yield _word_rows(langs.dictionary_encode(), data, starts, ends, text, *word_ids(data, starts, ends)[:2])


def _word_rows(langs, data, starts, ends, text, ids, rep) -> pa.RecordBatch:
    code = langs.indices.to_numpy(zero_copy_only=False)[text].astype(np.int64)
    both, count = np.unique((code << 32) | ids, return_counts=True)
    word = rep[both & 0xFFFFFFFF]
    return pa.RecordBatch.from_arrays(
        [langs.dictionary.take(pa.array(both >> 32)), strings(*spell(data, starts[word], ends[word]), pa.string()),
         pa.array(count, pa.int64())], names=["c0", "c1", "c2"])


def _pairs_of_sample(buckets: int):
    """c0 pair hash, c1 count, c2 suffixes of the chunk (in its first row only)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, starts, ends, _, length in _sliced(it):
            hashes = word_hashes(data, starts, ends)
            at = np.flatnonzero(length > 1)
            if not len(at):
                continue
            pair, count = np.unique(_pair_hash(hashes[at], hashes[at + 1]), return_counts=True)
            often = count * 4 * buckets >= len(at)
            often[0] = True
            total = np.zeros(int(often.sum()), np.int64)
            total[0] = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[often].view(np.int64)), pa.array(count[often], pa.int64()), pa.array(total)],
                names=["c0", "c1", "c2"])

    return run


def _route(buckets: int, hot_pairs):
    """Messages: c0 language, c1 bucket, c2 hot, c3 suffixes as lines of words, c4 their counts.
    Word counts travel in the same rows: c1 is null, c3 the word, c5 its count."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_list = hot_pairs.value
        for langs, data, starts, ends, text, length in _sliced(it):
            if not len(starts):
                continue
            langs = langs.dictionary_encode()
            ids, rep, hashes = word_ids(data, starts, ends)
            w = _word_rows(langs, data, starts, ends, text, ids, rep)
            none = pa.nulls(w.num_rows)
            yield pa.RecordBatch.from_arrays(
                [w.column(0), none.cast(pa.int64()), none.cast(pa.bool_()), w.column(1).cast(pa.binary()),
                 none.cast(pa.binary()), w.column(2)], names=[f"c{i}" for i in range(6)])
            code = langs.indices.to_numpy(zero_copy_only=False)[text].astype(np.int64)
            words, off = spell(data, starts, ends, gap=1)
            words[off[1:] - 1] = 0x20                        # a line is a part of these bytes
            del w, none, data, starts, ends, text
            at = np.flatnonzero(length > 1)
            for i in range(0, len(at), _CHUNK):
                yield from _messages(langs.dictionary, code, words, off, ids, hashes, length, at[i:i + _CHUNK],
                                     buckets, hot_list)

    return run


def _messages(langs, code, words, off, ids, hashes, length, at, buckets, hot_list) -> Iterator[pa.RecordBatch]:
    n, last = length[at], len(ids) - 1
    lead = hashes[ids[at]]
    pair = _pair_hash(lead, hashes[ids[at + 1]])
    third, fourth = (np.where(n > j, ids[np.minimum(at + j, last)], -1) for j in (2, 3))
    deep = mix(pair + np.where(n > 2, hashes[third], 0) * np.uint64(3))
    deep = mix(deep + np.where(n > 3, hashes[fourth], 0) * np.uint64(5))
    hot = np.zeros(len(at), bool)
    if len(hot_list):
        hot = hot_list[np.minimum(np.searchsorted(hot_list, pair), len(hot_list) - 1)] == pair
    group = (code[at] * 2 + hot) * buckets + (np.where(hot, deep, pair) % np.uint64(buckets)).astype(np.int64)
    order = _like_lines(group, lead, pair, deep)
    del lead, pair, deep, hot
    at, n, group, third, fourth = at[order], n[order], group[order], third[order], fourth[order]
    new = np.ones(len(at), bool)
    new[1:] = False
    for x in (group, ids[at], ids[at + 1], third, fourth):
        new[1:] |= x[1:] != x[:-1]
    new = np.flatnonzero(new)
    count = np.diff(np.append(new, len(at))).astype("<i4")
    at, n, group = at[new], n[new], group[new]
    del third, fourth, order, new
    for i in range(0, len(at), _LINES):
        yield _written(langs, words, off[at[i:i + _LINES]], off[at[i:i + _LINES] + n[i:i + _LINES]],
                       count[i:i + _LINES], group[i:i + _LINES], buckets)


def _like_lines(group: np.ndarray, lead: np.ndarray, pair: np.ndarray, deep: np.ndarray) -> np.ndarray:
    """An order by group; in it lines of one first word, of one pair, equal ones lie together.

    All is sorted as one number: the group, bits of the three hashes, the place. Equal lines that
    another one with the same bits parts are two lines of the message.
    """
    places = max(len(group) - 1, 1).bit_length()
    bits = 64 - places - int(group.max()).bit_length()
    if bits < 16:
        return np.lexsort((deep, pair, lead, group))
    both = group.astype(np.uint64)
    for x, own in ((lead, bits // 3), (pair, bits // 4), (deep, bits - bits // 3 - bits // 4)):
        both = (both << np.uint64(own)) | (x >> np.uint64(64 - own))
    both = (both << np.uint64(places)) | np.arange(len(group), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << places) - 1)).view(np.int64)


def _written(langs, words, starts, ends, count, group, buckets) -> pa.RecordBatch:
    new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    raw, off = spell(words, starts, ends)
    raw[off[1:] - 1] = 0x0A
    own = group[new]
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(own // (2 * buckets))), pa.array(own % buckets), pa.array(own // buckets % 2 == 1),
         strings(raw, off[np.append(new, len(count))], pa.binary()),
         strings(count.view(np.uint8), np.append(new, len(count)) * 4, pa.binary()),
         pa.nulls(len(new), pa.int64())], names=[f"c{i}" for i in range(6)])


def count_lines(payloads: list[bytes], counts: list[bytes], least: tuple[int, ...]):
    """Phrases of two to DEPTH words in lines of suffixes: (bytes, offsets, words, count)."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    weight = np.frombuffer(b"".join(counts), "<i4").astype(np.float64)
    space = _places(np.flatnonzero((data == 0x20) | (data == 0x0A)), data)
    starts, ends = np.append(space[:1] * 0, space[:-1] + 1), space
    ids = word_ids(data, starts, ends)[0]
    line_end = data[space] == 0x0A
    size = np.diff(np.flatnonzero(line_end), prepend=-1)
    first = np.cumsum(size) - size                           # of each line, among the words
    keys = np.zeros((len(weight), DEPTH), np.int32)
    for j in range(DEPTH):
        there = np.flatnonzero(size > j)
        keys[there, j] = ids[first[there] + j] + 1
    del ids, line_end, size
    ptr, depth, total = quicksort(keys, weight, least)
    ptr, depth, total = (x[depth > 1] for x in (ptr, depth, total))
    raw, off = spell(data, starts[first[ptr]], ends[first[ptr] + depth - 1])     # one space between words
    return raw, off, depth, total


def _counter(least: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, _, hot = (k.as_py() for k in key)
        bounds = (1,) * (DEPTH - 1) + (least,) if hot else (least,) * DEPTH
        raw, off, depth, total = count_lines(rows.column("text").to_pylist(), rows.column("counts").to_pylist(), bounds)
        partial = (depth < DEPTH) if hot else np.zeros(len(depth), bool)
        return pa.table({"lang": pa.array([lang] * len(depth), pa.string()),
                         "phrase": strings(raw, off, pa.string()), "f": pa.array(total, pa.int64()),
                         "partial": pa.array(partial)})

    return run


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30,
             bucket_suffixes: int = 1 << 21, sample_rows: int = 1 << 15) -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, phrase, f) of all phrases of one to four words with ``least``
    occurrences or more, and (lang, n), the words of each language.

    ``bucket_suffixes``: about so many suffixes are sorted together. ``sample_rows``: texts read
    to find pairs that would fill a bucket alone; the results do not depend on it.
    """
    spark = docs.sparkSession
    given = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                        F.col(f"`{text}`").alias("text")).where("text is not null and text != ''")
    volume = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * shuffle_parts(spark), volume // (_BYTES_A_WORD * bucket_suffixes))
    sample = map_in_arrow(bounded_sample(given, F.col("text"), sample_rows), _pairs_of_sample(buckets),
                          T.StructType().add("pair", "long").add("n", "long").add("suffixes", "long"))
    pairs = sample.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("suffixes").alias("suffixes"))
    pairs = materialise(pairs, "phrase-pairs")
    seen = pairs.agg(F.sum("suffixes")).first()[0] or 0
    # at most ``buckets`` pairs can hold a share of 1 / buckets
    hot = pairs.where((F.col("n") * buckets >= seen) & (F.col("n") >= 8)).select("pair").collect()
    hot = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hot], np.int64).view(np.uint64)))
    sent = materialise_messages(given, buckets, hot)
    words = (sent.where("bucket is null").groupBy("lang", F.col("text").cast("string").alias("phrase"))
             .agg(F.sum("n").alias("f")))
    words = materialise(words, "phrase-words")
    counted = (sent.where("bucket is not null").groupBy("lang", "bucket", "hot")
               .applyInArrow(_counter(least), "lang string, phrase string, f long, partial boolean"))
    counted = materialise(counted, "phrase-counts")
    parts = counted.where("partial").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    found = (words.unionByName(counted.where("not partial").drop("partial")).unionByName(parts)
             .where(F.col("f") >= least))
    return materialise(found, "phrases"), words.groupBy("lang").agg(F.sum("f").alias("n"))


def materialise_messages(given: DataFrame, buckets: int, hot) -> DataFrame:
    """The routed rows, written once: words and suffixes are read from the same pass."""
    schema = (T.StructType().add("lang", "string").add("bucket", "long").add("hot", "boolean")
              .add("text", "binary").add("counts", "binary").add("n", "long"))
    return materialise(map_in_arrow(given, _route(buckets, hot), schema), "phrase-messages")


def _joined(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, share: int = 80,
                 top: int = 2000, **routing) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    A phrase's score is that of its lowest cut, floor(2000000 * a / (l + r)); equal scores go
    to the shortest first part. A phrase goes where a longer one that contains it has at
    least ``share`` per cent of its occurrences.
    """
    known, totals = frequent(docs, text, lang, least, **routing)
    phrases = (known.withColumn("words", F.split("phrase", " ", -1)).withColumn("size", F.size("words"))
               .where("size > 1"))
    cuts = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), "words",
                          F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _joined(F.col("words"), 1, F.col("k")).alias("left"),
                       _joined(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = (cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
              .withColumn("score", F.expr("cast(cast(a as decimal(20, 0)) * 2000000 div "
                                          "(cast(l as decimal(20, 0)) + r) as bigint)")))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "size")).alias("b")).select("lang", "phrase", "b.*")
    inner = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1),
                              lambda s: _joined(F.col("words"), s, n)))))
    longer = (phrases.where("size > 2").select("lang", F.col("f").alias("longer"), F.explode(inner).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


#: The contract of op11 in DuckDB SQL.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' ')))
         AS phrase
  FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k)),
grams AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
known AS MATERIALIZED (
  SELECT lang, phrase, k AS size, f, string_split(phrase, ' ') AS words FROM grams WHERE f >= 30),
halves AS MATERIALIZED (
  SELECT lang, phrase, f AS a, j.k, array_to_string(words[1:j.k], ' ') AS first_part,
         array_to_string(words[j.k + 1:size], ' ') AS rest
  FROM known JOIN (SELECT unnest([1, 2, 3]) AS k) j ON j.k < size),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
         ((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM halves c JOIN known l ON l.lang = c.lang AND l.phrase = c.first_part
  JOIN known r ON r.lang = c.lang AND r.phrase = c.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(words[s:s + m - 1], ' ') AS phrase, max(f) AS longer
  FROM known, (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest([2, 3]) AS m)
  WHERE size > 2 AND m < size AND s + m - 1 <= size GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, t.n, b.score,
         row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b JOIN totals t USING (lang) LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR i.longer * 100 < b.a * 80)
WHERE rank <= 2000
"""
