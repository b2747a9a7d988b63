"""Personal data: fixed patterns, and a character BiLSTM-CRF for what is written otherwise.

1. ``base_spans``: e-mail addresses, IP addresses, card and phone numbers by fixed patterns with
   their checks.
2. ``fit``: a character-level bidirectional LSTM with CRF transitions is trained in numpy. Its
   labelled spans are base spans in windows of a bounded sample of the documents; in a third of
   the windows a span is rewritten the way people hide one (``name (at) host``, a phone number
   with 00 for +, a card number with dots), and digits that are no personal data are windows
   without spans.
3. ``scan``: every stretch of a text that has a digit, an ``@`` or an ``(at)`` with 32
   characters to both sides is cut into overlapping windows. The windows are decoded by
   forward-backward; where they overlap, the probabilities are averaged with more weight to a
   window's middle, and one Viterbi pass over the whole stretch reconciles them. A span is kept
   if its tags' mean probability is at least ``confidence`` and it touches no base span; its
   kind is ``near_email`` and so on. Stretches without those signs can't hold a span of these
   kinds, so nothing is left out.

Texts are not shuffled; the model has a fixed size.

Defined results: a null or empty text has no span; every input row gives one row, whatever its
id; extra columns are ignored; without any labelled span in the sample there is no model and the
base spans stand alone; positions are code points, end exclusive; very long texts are worked off
in groups of windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_sample
from ._text import utf8
from .bilstm_crf import Tagger, char_ids, new_tagger, train
from .secrets import luhn

KINDS = ("email", "ip", "card", "phone")
NEAR = tuple(f"near_{k}" for k in KINDS)
WINDOW, STRIDE, MARGIN = 96, 64, 32
_GROUP = 2048                                              # windows decoded together

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left and right, so that a long word without @ is read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at + 1)
        if host:
            start = at
            while start > free:                            # in steps back to the run's start
                low = max(free, start - 64)
                run = text[low:start]
                stops = [m.end() for m in _NOT_LOCAL.finditer(run)]
                if stops:
                    start = low + stops[-1]
                    break
                start = low
            if start < at:
                yield start, host.end()
                free = host.end()
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m.end() - m.start() - m[0].count(" ") - m[0].count("-")
        if 12 <= digits <= 19 and luhn(m[0]):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def _legal() -> tuple[np.ndarray, np.ndarray]:
    """Tags: 0 outside, 1 + 2k first and 2 + 2k further character of kind k."""
    n = 1 + 2 * len(KINDS)
    legal = np.ones((n, n), bool)
    start = np.ones(n, bool)
    for k in range(len(KINDS)):
        legal[:, 2 + 2 * k] = False
        legal[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return legal, start                                    # a window may begin inside a span


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_AT = re.compile(r"[(\[]at[)\]]", re.IGNORECASE)


def stretches(text: str, codes: np.ndarray) -> np.ndarray:
    """First and last + 1 character of every stretch around a sign of personal data."""
    sign = ((codes >= 48) & (codes <= 57)) | (codes == 64)
    at = np.flatnonzero(sign)
    if "at" in text or "AT" in text:
        hidden = [m.start() for m in _AT.finditer(text)] if "(" in text or "[" in text else []
        at = np.sort(np.concatenate((at, np.array(hidden, np.int64))))
    if not len(at):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(at) > 2 * MARGIN)
    first, last = np.append(at[0], at[cut + 1]), np.append(at[cut], at[-1])
    return np.column_stack((np.maximum(first - MARGIN, 0), np.minimum(last + MARGIN + 1, len(codes))))


def windows_of(stretch: tuple[int, int]) -> list[tuple[int, int]]:
    a, z = stretch
    out = [(s, min(s + WINDOW, z)) for s in range(a, max(a + 1, z - WINDOW + STRIDE), STRIDE)]
    return out


#: Ways to write a span that the patterns don't take; each takes the span and three small numbers.
def _hide(kind: str, span: str, way: int) -> str:
    if kind == "email":
        name, _, host = span.partition("@")
        at = ("(at)", " (at) ", "[at]", " [at] ", " @ ")[way % 5]
        return name + at + (host if way % 2 else host.replace(".", (" dot ", "(dot)")[way % 3 % 2]))
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "ip":
        return span.replace(".", ("[.]", " . ", "(.)")[way % 3])
    if kind == "card":
        return (". "[way % 2] * (1 + way % 2)).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return (f"00{digits}", f"00{digits[:2]} {digits[2:]}", f"00 {digits[:-7]} {digits[-7:]}",
            f"00{digits[:-7]}-{digits[-7:-4]}-{digits[-4:]}")[way % 4]


_EXAMPLE = "text string, kinds array<int>, starts array<int>, ends array<int>"


def _examples(per_row: int):
    """Windows with their base spans, at most ``per_row`` of a text: for training only."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple] = []
            for t in b.column(0).to_pylist():
                spans, codes = base_spans(t), codes_of(t)
                places = [w for s in stretches(t, codes) for w in windows_of((int(s[0]), int(s[1])))]
                step = max(1, len(places) // per_row)
                for a, z in places[::step][:per_row]:
                    own = [(KINDS.index(k), max(s, a) - a, min(e, z) - a) for k, s, e in spans if s < z and e > a]
                    out.append((t[a:z], *([o[j] for o in own] for j in range(3))))
            lists = [pa.array([o[j] for o in out], pa.list_(pa.int32())) for j in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), *lists],
                                             names=["text", "kinds", "starts", "ends"])

    return run


def _tagged(text: str, spans: list[tuple[int, int, int]], ids, mask, tags, row: int) -> None:
    n = min(len(text), WINDOW)
    ids[row, :n], mask[row, :n] = char_ids(codes_of(text))[:n], True
    for k, s, e in spans:
        tags[row, s:min(e, n)] = 2 + 2 * k
        if s < n:
            tags[row, s] = 1 + 2 * k


def training_set(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, mask and tags of the windows; in every third one with a span, one span is hidden."""
    n = len(rows)
    ids, mask = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), bool)
    tags = np.zeros((n, WINDOW), np.int64)
    for row, (text, kinds, starts, ends) in enumerate(rows):
        spans = list(zip(kinds, starts, ends))
        way = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big")
        whole = [s for s in spans if s[1] > 0 and s[2] < len(text)]
        apart = len(spans) < 2 or all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
        if whole and apart and way % 3 == 0:
            k, s, e = whole[way // 3 % len(whole)]
            new = _hide(KINDS[k], text[s:e], way // 9)
            grown = len(new) - (e - s)
            text = text[:s] + new + text[e:]
            spans = [(a, b + grown * (b > s), c + grown * (c >= e)) for a, b, c in spans if b < WINDOW]
            spans = [x for x in spans if x[1] < WINDOW]
        _tagged(text, spans, ids, mask, tags, row)
    return ids, mask, tags


def _trainer(steps: int):
    """One row: the trained tagger, if any window has a span."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for b in it for r in b.to_pylist()]
        if any(r[1] for r in rows):
            tagger = new_tagger(*_legal())
            train(tagger, *training_set(rows), steps=steps)
            yield pa.RecordBatch.from_arrays([pa.array([tagger.to_bytes()], pa.binary())], names=["model"])

    return run


def fit(docs: DataFrame, text: str = "text", sample_rows: int = 4000, sample_windows: int = 6000,
        steps: int = 300) -> Tagger | None:
    """The tagger, learned in one task from at most ``sample_windows`` windows of about
    ``sample_rows`` texts with a digit or an @ (chosen by hash); the driver gets the model."""
    given = docs.select(F.col(f"`{text}`").alias("text")).where(F.col("text").rlike(r"[0-9@]"))
    windows = (bounded_sample(given, F.col("text"), sample_rows).mapInArrow(_examples(4), _EXAMPLE).distinct()
               .orderBy(F.xxhash64("text", F.lit(3)), "text", "starts", "ends").limit(sample_windows))
    model = windows.coalesce(1).mapInArrow(_trainer(steps), "model binary").collect()
    return Tagger.from_bytes(bytes(model[0][0])) if model else None


def _decode(tagger: Tagger, texts: list[tuple[str, np.ndarray, np.ndarray]], confidence: float) -> list[list[tuple]]:
    """Spans of the tagger (kind number, start, end) in each text, given codes and stretches."""
    jobs = [(t, i, w) for t, (_, _, parts) in enumerate(texts) for i, s in enumerate(parts)
            for w in windows_of((int(s[0]), int(s[1])))]
    sums = {(t, i): np.zeros((int(s[1] - s[0]), tagger.tags)) for t, (_, _, parts) in enumerate(texts)
            for i, s in enumerate(parts)}
    weights = {k: np.zeros(len(v)) for k, v in sums.items()}
    encoded = [char_ids(c) if len(p) else None for _, c, p in texts]
    for at in range(0, len(jobs), _GROUP):
        group = jobs[at:at + _GROUP]
        ids, mask = np.zeros((len(group), WINDOW), np.int64), np.zeros((len(group), WINDOW), bool)
        for row, (t, _, (a, z)) in enumerate(group):
            ids[row, :z - a], mask[row, :z - a] = encoded[t][a:z], True
        prob = tagger.marginals(ids, mask)
        for row, (t, i, (a, z)) in enumerate(group):
            n, base = z - a, int(texts[t][2][i][0])
            middle = np.minimum(np.arange(n), np.arange(n)[::-1]) + 1.0
            sums[t, i][a - base:z - base] += prob[row, :n] * middle[:, None]
            weights[t, i][a - base:z - base] += middle
    out: list[list[tuple]] = [[] for _ in texts]
    for (t, i), total in sums.items():
        prob = total / weights[t, i][:, None]
        if prob[:, 0].min() > 0.5:
            continue
        path = tagger.viterbi(np.log(prob + 1e-12))
        base, s = int(texts[t][2][i][0]), 0
        inside = np.flatnonzero(path > 0)
        for s in inside[(path[inside] % 2 == 1) | ~np.isin(inside - 1, inside)]:
            k, e = (int(path[s]) - 1) // 2, int(s) + 1
            while e < len(path) and path[e] == 2 + 2 * k:
                e += 1
            if prob[np.arange(s, e), path[s:e]].mean() >= confidence:
                out[t].append((k, base + int(s), base + e))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_LEAST = 6                                                  # characters of a span of the tagger


def spans_of(texts: list[str], tagger: Tagger | None, confidence: float) -> list[list[dict]]:
    """All spans of each text, by start, then kind."""
    base = [base_spans(t) for t in texts]
    found: list[list[tuple]] = [[] for _ in texts]
    if tagger is not None:
        given = [(t, c := codes_of(t), stretches(t, c)) for t in texts]
        found = _decode(tagger, given, confidence)
    out = []
    for spans, more in zip(base, found):
        free = [(NEAR[k], s, e) for k, s, e in more
                if e - s >= _LEAST and not any(s < z and a < e for _, a, z in spans)]
        order = KINDS + NEAR
        out.append([{"kind": k, "start": s, "end": e} for k, s, e in
                    sorted(spans + free, key=lambda x: (x[1], order.index(x[0])))])
    return out


def scan(docs: DataFrame, tagger: Tagger | None, text: str = "text", key: str = "doc_id",
         confidence: float = 0.97) -> DataFrame:
    """``key`` and ``spans``: array of (kind, start, end), code points, end exclusive."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = np.zeros(256, bool)
        signs[48:58] = signs[[0x40, 0x28, 0x5B]] = True    # digits, @ and the brackets of (at)
        for b in it:
            data, off = utf8(b.column(1))
            seen = np.concatenate(([0], np.cumsum(signs[data])))
            at = np.flatnonzero(seen[off[1:]] > seen[off[:-1]])
            none: list = []
            out: list[list[dict]] = [none] * b.num_rows
            group: list[int] = []
            for j, row in enumerate(at):
                group.append(int(row))
                if j == len(at) - 1 or off[row + 1] - off[group[0]] > 4 << 20:
                    for i, spans in zip(group, spans_of(b.column(1).take(pa.array(group)).to_pylist(),
                                                        model.value, confidence)):
                        out[i] = spans
                    group = []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(_SPAN))], names=["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
            .mapInArrow(run, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
            .withColumnRenamed("key", key))


def digest(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """The contract's columns, from the spans of ``scan``."""
    found = scan(docs, tagger)
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    joined = lambda c: F.concat_ws(",", F.transform(
        c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
