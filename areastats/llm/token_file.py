"""Token-id files: tokenize, order by document, encode in independent blocks, read back.

Writing (``write``):

1. Texts are dealt into ranges of the document id (bounds from its quantiles), sorted and
   tokenized there, and written as blocks of whole documents of about ``BLOCK_TOKENS`` ids.
   Only this step moves texts, once; they travel zstd-compressed. An id (or the null id) that
   fills several ranges has ranges of its own, by a hash of the text, and a text that fills
   several of those is dealt over parts row by row.
2. The token counts of all tasks, kept while they tokenize, give one shared frequency table.
3. Each block is encoded by itself (``rans``) and written with the ids and lengths of its
   documents. Nothing else is needed to decode it but the shared table.

Format: a folder with ``table`` (symbol, count) and ``blocks`` (part, block, n_tokens,
doc_ids, doc_lens, payload), both Parquet; parts and blocks ascend with the document id.

Reading (``read_documents``): any executor decodes any block and checks it. Offsets come from
the token counts of the blocks: by part, then within the part.

A task tokenizes each different unit of its texts once (see ``WordEncoder``). Tokenizers that
do not split at white space, or keep it, are used with ``by_word=False``.

Defined results: a null text is empty; an empty text has the end id alone; rows that repeat an
id follow each other (in the order of a hash of their text); null ids come first; an empty
table gives an empty file. Whole texts are encoded. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rans
from ._spark import materialise, shuffle_parts
from ._text import SPACES, unique_hashes, utf8, word_hashes, word_spans

BLOCK_TOKENS = 1 << 18
CACHE_WORDS = 1_500_000


_OTHER, _LETTER, _DIGIT, _ODD = 1, 2, 3, 4
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[ord("'")] = _ODD                               # may begin a contraction
_CLASS[list(SPACES)] = 0
_CLASS = _CLASS.tobytes()
_LATIN = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}   # byte-level marks of bytes


class WordEncoder:
    """Ids of whole texts by one tokenizer file, with a bounded cache of what was encoded.

    A text is cut into units that never interact: words between ASCII spaces, and, where the
    tokenizer file says that it lowers case and splits runs of letters, single digits and runs
    of other marks, those parts of words of ASCII and precomposed Latin-1 letters. Each unit is
    encoded by the library once and then found by a 64-bit hash, its length and its first
    eight bytes. Texts that hold an added token's string are encoded whole.
    """

    #: The split whose parts of simple words are known without the library.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, by_word: bool = True):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_word = by_word
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        lowers = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.simple = (lowers == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
                       and steps[0]["pattern"].get("Regex") == self.SPLIT and steps[0]["behavior"] == "Removed"
                       and not steps[1]["add_prefix_space"])
        self.simple = self.simple and spec["model"]["type"] == "BPE" and not (spec["truncation"] or spec["padding"])
        self.part = self.tok.model                    # what is left for units without normalizer and splits
        self._clear()

    def _clear(self) -> None:
        self.hash, self.head = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.size, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)      # at: entry of each sorted hash
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _units(self, data: np.ndarray, off: np.ndarray):
        """Bytes (lowered in simple words), starts and ends of the units, which are simple."""
        starts, ends, _ = word_spans(data, off)
        if not self.simple or not len(starts):
            return data, starts, ends, np.zeros(len(starts), bool)
        kind = np.frombuffer(data.tobytes().translate(_CLASS), np.uint8).copy()
        pair = np.flatnonzero(data[:-1] == 0xC3)
        second = data[pair + 1]
        pair = pair[(second != 0x97) & (second != 0xB7)]   # the two marks among the letters
        kind[pair] = kind[pair + 1] = _LETTER
        odd = np.flatnonzero(kind == _ODD)
        plain = np.ones(len(starts), bool)
        plain[np.searchsorted(starts, odd, side="right") - 1] = False       # each lies in a word
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[plain]] += 1                    # starts differ from each other, as ends do
        inside[ends[plain]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        low = data.copy()
        low[inside & (data >= 65) & (data <= 90)] += 32
        big = pair[(data[pair + 1] >= 0x80) & (data[pair + 1] <= 0x9E) & inside[pair]]
        low[big + 1] += 32
        first = np.zeros(len(data), bool)
        first[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & (kind[1:] != 0)
        first[starts] = True
        at = np.flatnonzero(first)
        of_word = np.zeros(len(data), bool)
        of_word[starts] = True
        word = np.cumsum(of_word[at]) - 1
        end = np.minimum(np.append(at[1:], len(data)), ends[word])
        return low, at, end, plain[word]

    def _learn(self, h, data, starts, ends, simple) -> np.ndarray:
        """Cache entries of the units with these (sorted, distinct) hashes."""
        size = ends - starts
        eight = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
        beyond = (8 - np.minimum(size, 8)).astype(np.uint64) << np.uint64(3)      # no unit is empty
        head = (eight[starts] << beyond) >> beyond
        while True:
            i = np.searchsorted(self.hash, h)
            i[i == len(self.hash)] = 0
            hit = np.zeros(len(h), bool)
            if len(self.hash):
                hit = (self.hash[i] == h) & (self.head[i] == head) & (self.size[i] == size)
            if hit.all():
                return self.at[i]
            if len(self.hash) and len(self.hash) + (~hit).sum() > CACHE_WORDS:
                self._clear()
                continue
            raw = data.tobytes()
            for tok, new in ((self.tok, np.flatnonzero(~hit & ~simple)),
                             (self.part, np.flatnonzero(~hit & simple))):
                if not len(new):
                    continue
                spans = zip(starts[new].tolist(), ends[new].tolist())
                if tok is self.tok:
                    words = [raw[a:b].decode() for a, b in spans]
                    e = tok.encode(words, is_pretokenized=True, add_special_tokens=False)
                    n, ids = np.bincount(np.array(e.word_ids, np.int64), minlength=len(words)), e.ids
                else:                                 # the library's model, from the bytes' marks on
                    marks = raw.decode("latin-1")
                    words = [marks[a:b] for a, b in spans]
                    words = [[t.id for t in tok.tokenize(w if w.isascii() else w.translate(_LATIN))] for w in words]
                    n, ids = np.array([len(w) for w in words]), [i for w in words for i in w]
                entry = len(self.start) - 1 + np.arange(len(words))
                self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(n)))
                self.ids = np.concatenate((self.ids, np.array(ids, np.uint32)))
                where = np.searchsorted(self.hash, h[new])
                self.hash = np.insert(self.hash, where, h[new])
                self.head = np.insert(self.head, where, head[new])
                self.size = np.insert(self.size, where, size[new])
                self.at = np.insert(self.at, where, entry)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's offsets among them."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = np.full(len(texts), not self.by_word)
        for a in self.added if self.by_word else ():
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        data, off = utf8(texts)
        low, starts, ends, simple = self._units(data, off)
        h, at, back = unique_hashes(word_hashes(low, starts, ends))
        entry = self._learn(h, low, starts[at], ends[at], simple[at])[back]
        n = np.diff(self.start)[entry]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.start[entry] - total[:-1], n)]
        off = total[np.searchsorted(starts, off)]
        if not whole.any():
            return ids, off
        parts = [np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
                 if whole[i] else ids[off[i]:off[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_encoders: dict = {}


def encoder(path: str, by_word: bool) -> WordEncoder:
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = WordEncoder(path, by_word)
    return _encoders[path, by_word]


class _Steps:
    """Slots between ascending bounds; a bound of some width has as many slots of its own.

    Values up to a bound and above the one before share a slot, which the bound's own follow.
    """

    def __init__(self, widths: dict[int, int]):
        self.at = np.array(sorted(widths), np.int64)
        self.width = np.array([*(widths[b] for b in sorted(widths)), 0], np.int64)
        self.base = np.cumsum(self.width + 1) - self.width - 1
        self.slots = int(self.base[-1]) + 1

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot, number of the bound not under it, and whether it has slots of its own."""
        i = np.searchsorted(self.at, x)
        own = self.width[i] > 0
        own[own] = self.at[i[own]] == x[own]
        return self.base[i], i, own

    def spread(self, ties: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Slots where rows that fill a bound are interchangeable."""
        slot, i, own = self.place(ties)
        slot[own] += 1 + rows[own] % self.width[i[own]]
        return slot


class Ranges:
    """Parts in the order of (id, hash of the text), with about the same number of rows each.

    Quantiles give the bounds. An id that is several of them is hot: the space of hashes is
    cut evenly for it, and each hash of more rows than a part should have gets several slots.
    What goes through the driver has at most one row for each part.
    """

    def __init__(self, rows: DataFrame, parts: int):
        self.inner, self.null = {}, None
        if parts == 1:
            self.outer = _Steps({})
            self.parts = 1
            return
        n, known = rows.agg(F.count("*"), F.count("id")).first()
        share, cuts = max(1, n // parts), parts * known // max(1, n)
        at = rows.agg(F.percentile_approx("id", F.array(*[F.lit(i / cuts) for i in range(1, cuts)]),
                                          max(10000, 10 * cuts))).first()[0] if cuts > 1 else None
        times = Counter(at or [])
        wide = {i: m for i, m in times.items() if m > 1}
        if n - known >= 2 * share:
            wide[None] = (n - known) // share
        ties: dict = {i: {} for i in wide}
        if wide:
            hot = F.col("id").isin([i for i in wide if i is not None])
            if None in wide:
                hot = hot | F.col("id").isNull()
            heavy = rows.where(hot).groupBy("id", "tie").count().where(F.col("count") > share).collect()
            for r in heavy:
                ties[r["id"]][r["tie"]] = -(-r["count"] // share)
        step = {i: _Steps({**{-(1 << 63) + (j << 64) // m: 0 for j in range(1, m)}, **ties[i]})
                for i, m in wide.items()}
        self.null = step.pop(None, _Steps({}))
        self.outer = _Steps({i: step[i].slots if i in step else 0 for i in times})
        self.inner = {int(np.searchsorted(self.outer.at, i)): s for i, s in step.items()}
        self.first = self.null.slots if known < n else 0
        self.parts = self.first + self.outer.slots

    def __call__(self, ids: pa.Array, ties: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros(len(ids), np.int32)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        slot, at, own = self.outer.place(ids.fill_null(0).to_numpy())
        slot += self.first
        own &= ~null
        for i in np.unique(at[own]):
            mine = np.flatnonzero(own & (at == i))
            slot[mine] += 1 + self.inner[int(i)].spread(ties[mine], rows[mine])
        if null.any():
            slot[null] = self.null.spread(ties[null], rows[null])
        return slot.astype(np.int32)


_RAW = "part int, block int, doc_ids array<long>, doc_lens array<long>, ids binary, counts binary"


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each, if they fit, else in four."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def _tokenized(docs: DataFrame, path: str, end_id: int, key: str, text: str, by_word: bool) -> DataFrame:
    """Blocks of whole documents in the order of their id: the rows of ``_RAW``.

    Each task adds a row of block -1 with the number of times that it wrote each id.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"),
                       F.xxhash64(text).alias("tie"))
    ranges = Ranges(rows.select("id", "tie"), shuffle_parts(docs.sparkSession))

    def squeeze(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in it:
            part = ranges(b.column(0), b.column(2).to_numpy(), b.column(3).to_numpy())
            data, off = utf8(b.column(1))
            data, off = memoryview(data), off.tolist()
            packed = pa.array([z.compress(data[i:j]) for i, j in zip(off, off[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column(0), b.column(2), packed],
                                             names=["part", "id", "tie", "text"])

    dealt = (rows.withColumn("row", F.monotonically_increasing_id())
             .mapInArrow(squeeze, "part int, id long, tie long, text binary")
             .repartitionById(ranges.parts, F.col("part")).sortWithinPartitions("part", "id", "tie"))

    def tokenize(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        enc = encoder(path, by_word)
        state = {"part": None, "block": 0, "ids": [], "docs": [], "lens": [], "n": 0}
        times = np.zeros(1 << 16, np.int64)

        def flush():
            nonlocal times
            ids = np.concatenate(state["ids"])
            own = np.bincount(ids)
            if len(own) > len(times):
                times = np.concatenate((times, np.zeros(len(own) - len(times), np.int64)))
            times[:len(own)] += own
            out = pa.RecordBatch.from_arrays(
                [pa.array([state["part"]], pa.int32()), pa.array([state["block"]], pa.int32()),
                 pa.array([state["docs"]], pa.list_(pa.int64())), pa.array([state["lens"]], pa.list_(pa.int64())),
                 pa.array([_narrow(ids)], pa.binary()), pa.nulls(1, pa.binary())],
                names=["part", "block", "doc_ids", "doc_lens", "ids", "counts"])
            state.update(block=state["block"] + 1, ids=[], docs=[], lens=[], n=0)
            return out

        for b in it:
            part_of, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            row = 0
            while row < b.num_rows:                   # a few megabytes of text at a time
                texts, size = [], 0
                a = row
                while row < b.num_rows and (not texts or size < 4 << 20):
                    texts.append(z.decompress(b.column(3)[row].as_py()))
                    size += len(texts[-1])
                    row += 1
                got, off = enc.encode(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
                got = np.insert(got, off[1:], end_id).astype(np.uint32, copy=False)
                off = (off + np.arange(len(off))).tolist()
                for i in range(len(texts)):
                    if part_of[a + i] != state["part"]:
                        if state["docs"]:
                            yield flush()
                        state.update(part=part_of[a + i], block=0)
                    own = got[off[i]:off[i + 1]]
                    state["ids"].append(own)
                    state["docs"].append(ids[a + i])
                    state["lens"].append(len(own))
                    state["n"] += len(own)
                    if state["n"] >= BLOCK_TOKENS:
                        yield flush()
        if state["docs"]:
            yield flush()
        at = np.flatnonzero(times)
        if len(at):
            both = np.concatenate((at, times[at])).astype("<i8").tobytes()
            none = pa.nulls(1, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), none, none, pa.nulls(1, pa.binary()),
                 pa.array([both], pa.binary())], names=["part", "block", "doc_ids", "doc_lens", "ids", "counts"])

    return dealt.mapInArrow(tokenize, _RAW)


def _frequencies(raw: DataFrame) -> DataFrame:
    """symbol, count over all blocks, from what the tasks counted."""
    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for x in b.column(0):
                at, times = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(times)], names=["symbol", "n"])

    counted = raw.where("block < 0").select("counts").mapInArrow(rows, "symbol long, n long")
    return counted.groupBy("symbol").agg(F.sum("n").alias("count"))


def _table(spark: SparkSession, path: str):
    """The shared table: as many rows as the vocabulary has, whatever the corpus."""
    rows = spark.read.schema("symbol long, count long").parquet(f"{path}/table").toArrow()
    return spark.sparkContext.broadcast(rans.Table(rows.column(0).to_numpy(), rows.column(1).to_numpy()))


_BLOCKS = "part int, block int, n_tokens long, doc_ids array<long>, doc_lens array<long>, payload binary"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id",
          text: str = "text", by_word: bool = True) -> None:
    """Encode all texts into a new folder ``path`` (on storage that all executors share)."""
    spark = docs.sparkSession
    raw = materialise(_tokenized(docs, tokenizer_path, end_id, key, text, by_word), "token-blocks")
    _frequencies(raw).coalesce(1).write.parquet(f"{path}/table")
    table = _table(spark, path)

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in it:
            for i in range(b.num_rows):               # one block at a time in memory
                ids = _wide(b.column(4)[i].as_py(), pc.sum(b.column(3)[i].values).as_py())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([len(ids)], pa.int64()),
                     b.column(2).slice(i, 1), b.column(3).slice(i, 1), pa.array([rans.encode(ids, t)], pa.binary())],
                    names=["part", "block", "n_tokens", "doc_ids", "doc_lens", "payload"])

    blocks = raw.where("block >= 0").drop("counts")
    blocks.mapInArrow(pack, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the file."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    table = _table(spark, path)

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in it:
            for i in range(b.num_rows):
                ids = rans.decode(b.column(4)[i].as_py(), t).astype("<u4")
                lens = np.array(b.column(3)[i].as_py(), np.int64)
                off = np.concatenate(([0], np.cumsum(lens)))
                if off[-1] != len(ids):
                    raise ValueError("a block's lengths do not match its tokens")
                crc = [zlib.crc32(ids[off[j]:off[j + 1]].tobytes()) for j in range(len(lens))]
                n = len(lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b.column(0)[i].as_py(), np.int32)),
                     pa.array(np.full(n, b.column(1)[i].as_py(), np.int32)), b.column(2).slice(i, 1).flatten(),
                     pa.array(off[:-1]), pa.array(lens), pa.array(crc, pa.int64())],
                    names=["part", "block", "doc_id", "own", "n_tokens", "ids_crc32"])

    # a row for each block: the running sum within a part, and of the parts before it
    sizes = blocks.select("part", "block", "n_tokens")
    in_part = Window.partitionBy("part").orderBy("block")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    offsets = (sizes.withColumn("in_part", F.sum("n_tokens").over(in_part) - F.col("n_tokens"))
               .join(before_part, "part").select("part", "block", (F.col("in_part") + F.col("before")).alias("base")))
    return (blocks.select("part", "block", "doc_ids", "doc_lens", "payload")
            .mapInArrow(unpack, "part int, block int, doc_id long, own long, n_tokens long, ids_crc32 long")
            .join(offsets, ["part", "block"])
            .select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (array) of every document of a file."""
    table = _table(spark, path)

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                ids = rans.decode(b.column(2)[i].as_py(), table.value).astype(np.int32)
                off = np.concatenate(([0], np.cumsum(b.column(1)[i].as_py()))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1).flatten(), pa.ListArray.from_arrays(pa.array(off), pa.array(ids))],
                    names=["doc_id", "ids"])

    return (spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").select("doc_ids", "doc_lens", "payload")
            .mapInArrow(unpack, "doc_id long, ids array<int>"))
