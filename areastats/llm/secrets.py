"""Secret scan: keyword automaton, anchored patterns only at its hits, embedded checksums.

1. An Aho-Corasick automaton finds every keyword of every rule in one pass over a text whose
   ASCII letters are lowered (so code-point positions do not move).
2. Each rule's pattern is tried only at the hits of its keywords, anchored there.
3. Rules whose tokens carry a check value keep a match only if it verifies.

The ``hex`` rule has no keyword (a run of 24 or more hex digits), so its pattern reads the
text directly. Matches of one kind do not overlap and the leftmost wins.

Defined results: a null text counts as empty and has no span; an empty text likewise; rows are
independent, so repeated rows and repeated or null ids give one result row each; extra columns
of the input are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import batch_of, map_in_arrow

_FLAGS = re.ASCII
_LOWER = {c: c + 32 for c in range(65, 91)}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_suffix(token: str) -> bool:
    """The last six characters are the base-62 CRC-32 of what stands between prefix and them."""
    body, check = token[token.index("_") + 1:-6], token[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, rest = divmod(value, 62)
        digits = _BASE62[rest] + digits
    return digits.rjust(6, "0") == check


def jwt_header(token: str) -> bool:
    """The first part decodes to a JSON object that names an algorithm."""
    part = token.split(".")[0]
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


def luhn(token: str) -> bool:
    """The Luhn digit sum of the digits is a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed([c for c in token if c.isdigit()])):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


@dataclass(frozen=True)
class Rule:
    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    accept: Callable[[re.Match], bool]


#: Order matters where two spans start together. The first three are the base kinds.
RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", _FLAGS | re.IGNORECASE),
         lambda m: m.end(2) - m.start(2) >= 6),
    Rule("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+", _FLAGS),
         lambda m: m.end() - m.start() >= 20),
    Rule("hex", (), re.compile(r"[0-9a-f]{24,}", _FLAGS), lambda m: True),
    Rule("forge_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
         re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", _FLAGS),
         lambda m: crc_suffix(m[0])),
    Rule("registry_token", ("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", _FLAGS),
         lambda m: crc_suffix(m[0])),
    Rule("jwt", ("eyj",),
         re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", _FLAGS),
         lambda m: jwt_header(m[0])),
    Rule("private_key", ("-----begin ",),
         re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?"
                    r"-----END [A-Z ]*PRIVATE KEY-----", _FLAGS), lambda m: True),
    Rule("card", ("card", "visa", "mastercard", "amex"),
         re.compile(r"(?:card|visa|mastercard|amex)(?:\x20*(?:number|no\.?))?\x20*[:=#]\x20*"
                    r"[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])", _FLAGS | re.IGNORECASE),
         lambda m: luhn(m[0])),
)
BASE_KINDS = ("assign", "access", "hex")

_automata: dict = {}


def automaton():
    """Keyword -> rules, built once per worker process."""
    if "main" not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        found: dict[str, list[int]] = {}
        for i, rule in enumerate(RULES):
            for k in rule.keywords:
                found.setdefault(k, []).append(i)
        for k, rules in found.items():
            a.add_word(k, (len(k), tuple(rules)))
        a.make_automaton()
        _automata["main"] = a
    return _automata["main"]


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All accepted spans (kind, start, end) in code points, by start, then order of rules."""
    if not text:
        return []
    lowered = text.lower() if text.isascii() else text.translate(_LOWER)
    starts: dict[int, list[int]] = {}
    for end, (length, rules) in automaton().iter(lowered):
        for r in rules:
            starts.setdefault(r, []).append(end - length + 1)
    found: list[tuple[int, int, int]] = []
    for r, at in starts.items():
        rule, free = RULES[r], 0
        for s in sorted(at):
            if s < free:
                continue
            m = rule.pattern.match(text, s)
            if m:
                free = m.end()
                if rule.accept(m):
                    found.append((s, r, free))
    for r, rule in enumerate(RULES):
        if not rule.keywords:
            found += [(m.start(), r, m.end()) for m in rule.pattern.finditer(text)]
    return [(RULES[r].kind, s, e) for s, r, e in sorted(found)]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``spans``: array of (kind, start, end), code points, end exclusive."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for t in b.column(1):
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t.as_py())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(_SPAN))],
                                             names=["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(run, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
            .withColumnRenamed("key", key))


def redact_text(text: str | None) -> str | None:
    """The text with every span (overlapping ones joined) replaced by ``[kind]``."""
    spans = spans_of(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, each secret in ``text`` replaced by its kind in brackets."""
    at = docs.columns.index(text)
    schema = docs.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new = pa.array([redact_text(t.as_py()) for t in b.column(at)], b.schema.field(at).type)
            yield batch_of([new if i == at else b.column(i) for i in range(b.num_columns)])

    return map_in_arrow(docs, run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the spans of ``scan``."""
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    joined = lambda c: F.concat_ws(",", F.transform(
        c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> tuple[list[str], str]:
    """Base spans by plain scanning of the whole text, for tests."""
    text, found = text or "", []
    for i, r in enumerate(RULES[:3]):
        p = re.compile(r"[0-9a-f]+") if r.kind == "hex" else r.pattern
        for m in p.finditer(text):
            if r.accept(m) and (r.kind != "hex" or len(m[0]) >= 24):
                found.append((m.start(), i, m.end()))
    parts = [f"{RULES[i].kind}:{s}:{e}" for s, i, e in sorted(found)]
    return parts, hashlib.sha256(",".join(parts).encode()).hexdigest()
