"""Benchmark decontamination: every passage of every text queries a BM25 index of test items.

The index holds, per term, the items it occurs in with their BM25 weight divided by the item's
own full score, so a passage that contains an item scores 1 against it and one threshold
serves all items. Items are ordered by length and cut into blocks; each term also keeps its
largest weight in each block (block-max).

Items are searched by classes of length: up to 8 words, 16, 32 and so on. The passages of a class
are twice that many words, one such length apart, so every item that stands in a text stands whole
in some passage; an item's passages depend on its own length alone, not on what else is in the
benchmark or in its group. Retrieval is exact for the threshold:

1. WAND: the most frequent terms, as long as together they can't reach half the threshold for
   any item, are non-essential: they count with that one bound. A passage whose other terms'
   largest weights do not lift that bound to the threshold is skipped (running sums over the
   text, no work per passage).
2. Block-max: for the passages left, only blocks whose summed block maxima reach the threshold
   are scored, with full weights.
3. Every item above the threshold is verified: of the word trigrams of its question at least
   ``question_overlap``, and of its answer at least ``answer_overlap``, occur in the passage.
   The answer is the ``answer`` column if the items have one. Else it is the last sentence, or
   the last third of the words of a text of one sentence, with words moved between question and
   answer until both are long enough to pass with any one word changed; an item too short for
   that is all question. (Unchanged limits: an ``answer`` column is taken as it is, and items of
   fewer than eight distinct trigrams need 0.6 of them.)

Words are lower case runs of ASCII letters, digits and other code points that are not
punctuation or symbols.

The index is built from at most ``index_bytes`` of items at a time (checked); more items are
taken in groups by a hash of their id, one pass over the texts for each, with the same corpus
statistics. Texts are not shuffled.

Defined results: null or empty texts and items match nothing; repeated items of the same id
and text count once; repeated documents are each reported; null ids are reported as null; an
empty benchmark gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._spark import map_in_arrow
from ._text import rolling, slices, utf8, word_hashes

THRESHOLD = 0.6
MIN_QUESTION, MIN_ANSWER = 8, 6    # distinct trigrams: less three, still 0.6 and 0.5 of them
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_ALNUM[128:] = True


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of a text column and each text's offsets among them."""
    data, off = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    word = _ALNUM[data]
    c2 = np.flatnonzero(data == 0xC2)                 # U+0080-U+00BF
    word[c2] = word[c2 + 1] = False
    e2 = np.flatnonzero((data == 0xE2) | (data == 0xE3))
    second = data[e2 + 1]
    e2 = e2[np.where(data[e2] == 0xE2, second < 0xB0, second == 0x80)]   # U+2000-U+2BFF, U+3000-
    word[e2] = word[e2 + 1] = word[e2 + 2] = False
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
    return word_hashes(data, starts, np.flatnonzero(last) + 1), np.searchsorted(starts, off)


def fit_cut(words: np.ndarray, cut: int) -> int:
    """Where to cut an item's words, near ``cut``, so that one changed word spoils neither part.

    A changed word destroys up to three trigrams, so the answer is given words from before it
    until it has MIN_ANSWER distinct trigrams, and a question with fewer than MIN_QUESTION is
    given words of the answer. An item too short for both is one part, all question.
    """
    grams3 = rolling(words, np.array([0, len(words)]), 3)[0]
    new = lambda g: np.cumsum(np.isin(np.arange(len(g)), np.unique(g, return_index=True)[1]))
    least = int(np.searchsorted(new(grams3), MIN_QUESTION)) + 3
    most = len(words) - int(np.searchsorted(new(grams3[::-1]), MIN_ANSWER)) - 3
    return len(words) if least > most else min(max(cut, least), most)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item that has one text only."""
    parts = [p for p in text.replace("\n", " ").split(". ") if p.strip()]
    if len(parts) > 1:
        cut = sum(len(p.split()) for p in parts[:-1])
        words = " ".join(parts).split()
    else:
        words = text.split()
        cut = min(len(words), max(1, len(words) * 2 // 3))
    hashes, off = term_hashes(pa.array(words, pa.string()))
    # a cut inside a word (several terms, one word of the text) is moved to the nearer whole one
    at = fit_cut(hashes, int(off[cut]))
    cut = int(np.searchsorted(off, at)) if at < off[cut] else int(np.searchsorted(off, at, side="right")) - 1
    return (" ".join(words), "") if at >= len(hashes) else (" ".join(words[:cut]), " ".join(words[cut:]))


def grams(words: np.ndarray, n: int = 3) -> np.ndarray:
    """Distinct word n-grams of one text (shorter texts: the text itself)."""
    n = max(1, min(n, len(words)))
    return np.unique(rolling(words, np.array([0, len(words)]), n)[0])


class Index:
    """The items' words and terms, and a ``_LengthClass`` for each class of lengths."""

    def __init__(self, items: list[tuple], n: int, mean: float, df: dict[int, int],
                 threshold: float, block: int = 16, k1: float = 1.2, b: float = 0.75):
        """items: (id, question words, answer words); n, mean, df: over the whole benchmark."""
        items = sorted(items, key=lambda i: len(i[1]) + len(i[2]))
        self.ids = [i[0] for i in items]
        self.parts = [(i[1], i[2]) for i in items]
        triples = []
        for at, (q, a) in enumerate(self.parts):
            terms, tf = np.unique(np.concatenate((q, a)), return_counts=True)
            d = np.array([df[int(t)] for t in terms], float)
            idf = np.log1p((n - d + 0.5) / (d + 0.5))
            w = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * (len(q) + len(a)) / mean))
            triples.append((terms, np.full(len(terms), at), w / w.sum()))
        terms, item, w = (np.concatenate([t[j] for t in triples]) for j in range(3))
        self.terms, number = np.unique(terms, return_inverse=True)
        length = np.array([len(q) + len(a) for q, a in self.parts])
        size = 8 << np.maximum(0, np.ceil(np.log2(np.maximum(length, 1) / 8)).astype(int))
        self.classes = []
        for c in np.unique(size):
            own, members = np.flatnonzero(size[item] == c), np.flatnonzero(size == c)
            self.classes.append(_LengthClass(int(c), members, number[own], np.searchsorted(members, item[own]), w[own],
                                             len(self.terms), threshold, block))
        bits = max(16, int(4 * len(self.terms)).bit_length() + 2)
        self.mask = np.uint64((1 << bits) - 1)
        self.known = np.zeros(1 << bits, bool)
        self.known[(self.terms & self.mask).astype(np.int64)] = True

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The term number of each word; words outside the index get the number after the last."""
        out = np.full(len(words), len(self.terms), np.int64)
        maybe = np.flatnonzero(self.known[(words & self.mask).astype(np.int64)])
        at = np.searchsorted(self.terms, words[maybe])
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == words[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def search(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text number, first word, last word + 1, item, score) of all hits, unverified."""
        number = self.numbers(words)
        for c in self.classes:
            yield from c.search(number, first)

    def overlaps(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and of the answer's trigrams that the passage has."""
        out = []
        for part in self.parts[item]:
            if not len(part):
                out.append(1.0)
                continue
            n = min(3, len(part))
            own = grams(part, n)
            out.append(float(np.isin(own, grams(passage, n)).mean()) if len(passage) >= n else 0.0)
        return out[0], out[1]


class _LengthClass:
    """Postings with normalised BM25 weights and block maxima of the items of one class."""

    def __init__(self, size: int, members: np.ndarray, terms: np.ndarray, item: np.ndarray, weight: np.ndarray,
                 n_terms: int, threshold: float, block: int):
        """members: the index's numbers of the items; terms, item, weight: their postings."""
        self.size, self.members, self.threshold, self.block, self.n_terms = size, members, threshold, block, n_terms
        order = np.lexsort((item, terms))
        terms, self.item, self.weight = terms[order], item[order], weight[order]
        self.start = np.searchsorted(terms, np.arange(n_terms + 1))
        self.n_blocks = -(-len(members) // block)
        code = terms * self.n_blocks + self.item // block
        at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        self.block_of = code[at] % self.n_blocks
        self.block_max = np.maximum.reduceat(self.weight, at)
        self.block_start = np.searchsorted(code[at], np.arange(n_terms + 1) * self.n_blocks)
        top = np.zeros(n_terms + 1)
        np.maximum.at(top, terms, self.weight)
        # non-essential terms: frequent ones first, while together under half the threshold
        sums = np.zeros(len(members))
        for t in np.argsort(-np.diff(self.start), kind="stable"):
            p = slice(self.start[t], self.start[t + 1])
            if p.start == p.stop or (sums[self.item[p]] + self.weight[p]).max() > threshold / 2:
                break
            sums[self.item[p]] += self.weight[p]
            top[t] = 0.0
        self.base = float(sums.max())
        self.essential_max = top

    def _gather(self, terms: np.ndarray, start: np.ndarray) -> np.ndarray:
        n = start[terms + 1] - start[terms]
        return np.repeat(start[terms] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Items whose score for the passage with these distinct terms reaches the threshold."""
        if not len(terms):
            return []
        eps = 1e-9
        p = self._gather(terms, self.block_start)
        upper = np.bincount(self.block_of[p], self.block_max[p], self.n_blocks)
        alive = upper >= self.threshold - eps
        if not alive.any():
            return []
        p = self._gather(terms, self.start)
        p = p[alive[self.item[p] // self.block]]
        score = np.bincount(self.item[p], self.weight[p], len(self.members))
        return [(int(self.members[i]), float(score[i])) for i in np.flatnonzero(score >= self.threshold - eps)]

    def search(self, number: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        sums = np.concatenate(([0.0], np.cumsum(self.essential_max[number])))
        width, step = 2 * self.size, self.size
        n = np.diff(first)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - width) // step)), 0)
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        a = first[text] + k * step
        z = np.minimum(a + width, first[text + 1])
        for i in np.flatnonzero(self.base + sums[z] - sums[a] >= self.threshold - 1e-6):
            terms = np.unique(number[a[i]:z[i]])
            for item, score in self.retrieve(terms[terms < self.n_terms]):
                yield int(text[i]), int(a[i]), int(z[i]), item, score


def _load_items(items: DataFrame, key: str, text: str, answer: str | None):
    cols = [F.col(key).alias("key"), F.col(text).alias("q"),
            (F.col(answer) if answer else F.lit(None)).cast("string").alias("a")]
    return items.select(*cols).where(F.col("q").isNotNull() & (F.col("q") != "")).distinct()


def _indexes(items: DataFrame, item_key: str, item_text: str, answer: str | None, threshold: float,
             index_bytes: int) -> Iterator:
    """The broadcast index of each group of items (one group, unless they exceed ``index_bytes``)."""
    item_kind = items.schema[item_key].dataType.simpleString()
    rows = _load_items(items, item_key, item_text, answer)

    def words_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            q, a = b.column(1).to_pylist(), b.column(2).to_pylist()
            pairs = [split_item(x) if y is None else (x, y) for x, y in zip(q, a)]
            done = []
            for j in (0, 1):
                w, off = term_hashes(pa.array([p[j] for p in pairs], pa.string()))
                done.append([w[off[i]:off[i + 1]].astype(np.int64).tolist() for i in range(len(pairs))])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(d, pa.list_(pa.int64())) for d in done)],
                                             names=["key", "q", "a"])

    parsed = (rows.mapInArrow(words_of, f"key {item_kind}, q array<long>, a array<long>")
              .where((F.size("q") + F.size("a")) > 0))
    size = (parsed.agg(F.count("*"), F.avg(F.size("q") + F.size("a")),
                       F.sum(F.size("q") + F.size("a") + 8)).first())
    n, mean, volume = size[0], size[1], 8 * (size[2] or 0)
    groups = max(1, -(-volume // index_bytes))
    terms = parsed.select("key", "q", "a", F.explode(F.array_distinct(F.concat("q", "a"))).alias("t"))
    df_all = terms.groupBy("t").agg(F.count("*").alias("df"))
    for g in range(groups if n else 0):
        own = parsed.where(F.pmod(F.xxhash64("key", "q"), F.lit(groups)) == g)
        own_terms = own.select(F.explode(F.concat("q", "a")).alias("t")).distinct()
        df = {r["t"] & (1 << 64) - 1: r["df"] for r in df_all.join(own_terms, "t").collect()}
        loaded = sorted(own.collect(), key=lambda r: (str(r["key"]), r["q"], r["a"]))
        if not loaded:
            continue
        as_words = lambda x: np.array(x, np.int64).astype(np.uint64)
        yield items.sparkSession.sparkContext.broadcast(
            Index([(r["key"], as_words(r["q"]), as_words(r["a"])) for r in loaded], n, mean, df, threshold))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", answer: str | None = None,
                  threshold: float = THRESHOLD, question_overlap: float = 0.6,
                  answer_overlap: float = 0.5, index_bytes: int = 32 << 20) -> DataFrame:
    """``key``, ``item_key``, score, question_overlap, answer_overlap, start_word: one row for
    each document and each test item found in it (its best passage)."""
    kind, item_kind = (d.schema[k].dataType.simpleString() for d, k in ((docs, key), (items, item_key)))
    schema = (f"key {kind}, item {item_kind}, score double, question_overlap double, "
              "answer_overlap double, start_word long")
    item_type = to_arrow_type(items.schema[item_key].dataType)
    found = None
    for index in _indexes(items, item_key, item_text, answer, threshold, index_bytes):
        part = (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
                .mapInArrow(_searcher(index, question_overlap, answer_overlap, item_type), schema))
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"key": key, "item": item_key})


def _searcher(index, question_overlap: float, answer_overlap: float, item_type: pa.DataType):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for whole in it:
            for b in slices(whole, "text"):
                words, first = term_hashes(b.column(1))
                best: dict[tuple[int, object], tuple] = {}
                for row, a, z, item, score in ix.search(words, first):
                    name = (row, ix.ids[item])
                    if name in best and best[name][0] >= score:
                        continue
                    q, ans = ix.overlaps(item, words[a:z])
                    if q >= question_overlap and ans >= answer_overlap:
                        best[name] = (score, q, ans, a - int(first[row]))
                if best:
                    at = pa.array([r for r, _ in best])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), pa.array([i for _, i in best], item_type),
                         *(pa.array([v[j] for v in best.values()], t) for j, t in
                           enumerate((pa.float64(), pa.float64(), pa.float64(), pa.int64())))],
                        names=["key", "item", "score", "question_overlap", "answer_overlap", "start_word"])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                      item_key: str = "item_id", item_text: str = "text", answer: str | None = None,
                      threshold: float = THRESHOLD, question_overlap: float = 0.6,
                      answer_overlap: float = 0.5, index_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` in whose own text no test item was found; same columns.

    Each row is decided where it is read, by its text alone: ids (``key``) may be null or
    repeated. Nothing is shuffled.
    """
    at = docs.columns.index(text)
    for index in _indexes(items, item_key, item_text, answer, threshold, index_bytes):
        docs = map_in_arrow(docs, _dropper(index, f"c{at}", question_overlap, answer_overlap), docs.schema)
    return docs


def _dropper(index, text: str, question_overlap: float, answer_overlap: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for whole in it:
            for b in slices(whole, text):
                words, first = term_hashes(b.column(b.schema.get_field_index(text)))
                clean = np.ones(b.num_rows, bool)
                for row, a, z, item, _ in ix.search(words, first):
                    if clean[row]:
                        q, ans = ix.overlaps(item, words[a:z])
                        clean[row] = q < question_overlap or ans < answer_overlap
                yield b if clean.all() else b.filter(pa.array(clean))

    return run
