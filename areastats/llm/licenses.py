"""Licence scan by sentence rules.

1. A text is cut into units (sentence ends and line ends; a known sentence may also begin inside
   one, at words that begin such sentences). Units are normalised: lower case,
   spelling and version forms unified, marks dropped; units without words don't count.
   Consecutive units are joined where a sentence is wrapped over lines, up to ``LONGEST`` words,
   whatever the lines' width, and only as long as some known sentence can go on like this (its
   word prefixes; patterns by partial matching). A sentence ends where a unit ends, and holds
   one of the ``KEYWORDS``: units too far before the next of them begin none.
2. A normalised sentence that is known maps to its identifier: fixed sentences by lookup, those
   with variable parts (names, versions, addresses) by a pattern over the whole sentence.
3. The sequence of identifiers is matched against ordered rules, the longest first; up to
   ``MAX_GAP`` unknown units may stand between two sentences of a rule. Known sentences that no
   rule takes are reported as ``unknown``, so that nothing recognised is lost.

Texts without one of the ``KEYWORDS`` are passed over: every known sentence holds one of them
(tested), so nothing is missed. Each row is handled by itself; there is no shuffle.

Defined results: null and empty texts have no finding; repeated rows and ids are each reported;
extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_GAP = 2
KEYWORDS = ("licen", "copyright", "redistribut", "warrant", "permission", "public domain",
            "damages", "free software", "of the mpl", "this software")

#: Known sentences of public licences in normal form, by identifier.
SENTENCES = {
    "apache_licensed": "licensed under the apache license version 2.0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under "
                    "the license is distributed on an as is basis without warranties or conditions of any "
                    "kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under "
                  "the license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this "
                 "software and associated documentation files the software to deal in the software without "
                 "restriction including without limitation the rights to use copy modify merge publish "
                 "distribute sublicense and or sell copies of the software and to permit persons to whom "
                 "the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including "
                 "but not limited to the warranties of merchantability fitness for a particular purpose and "
                 "noninfringement",
    "mit_liability": "in no event shall the authors or copyright holders be liable for any claim damages or "
                     "other liability whether in an action of contract tort or otherwise arising from out of "
                     "or in connection with the software or the use or other dealings in the software",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification "
                          "are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of "
                  "conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of "
                  "conditions and the following disclaimer in the documentation and or other materials "
                  "provided with the distribution",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or "
                 "without fee is hereby granted provided that the above copyright notice and this permission "
                 "notice appear in all copies",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this "
                 "software including all implied warranties of merchantability and fitness",
    "mpl_2": "this source code form is subject to the terms of the mozilla public license version 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense_grant": "anyone is free to copy modify publish use compile sell or distribute this software "
                       "either in source code form or as a compiled binary for any purpose commercial or non "
                       "commercial and by any means",
}
#: Sentences with variable parts. Named groups become the licence's details.
PATTERNS = {
    "spdx": r"spdx license identifier (?P<name>.+)",
    "copyright": r"(?:portions )?copyright (?:c|by|[0-9]{4})(?: .*)?|(?:portions )?copyright .{1,120} all rights reserved",
    "apache_copy": r"you may obtain a copy of the license at(?: .*)?",
    "apache_short": r"(?:this .{1,60} is |released |distributed |licensed |available )*(?:licensed |released )?under "
                    r"(?:the )?apache license(?: version)? (?P<version>2\.0)(?: license)?",
    "mit_short": r"(?:this .{1,60} is |it is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of "
                 r"the )?mit license",
    "bsd_short": r"(?:this .{1,60} is |it is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of "
                 r"the )?bsd (?P<clauses>[23]) clause license",
    "gnu_short": r"(?:this .{1,60} is |it is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of "
                 r"the )?gnu (?P<kind>lesser |affero )?general public license version (?P<version>[23](?:\.[01])?)"
                 r"(?P<later> or later| or any later version)?",
    "cc_short": r"(?:this .{1,60} is |it is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:creative "
                r"commons|cc) (?P<terms>by(?: nc)?(?: sa| nd)?|zero|0) (?P<version>[1-4]\.0)(?: international)?"
                r"(?: license)?",
    "bsd_endorse": r"neither the names? of .{1,120} nor the names of its contributors may be used to endorse or "
                   r"promote products derived from this software without specific prior written permission",
    "bsd_as_is": r"this software is provided by .{1,120} as is and any express or implied warranties including but "
                 r"not limited to the implied warranties of merchantability and fitness for a particular purpose "
                 r"are disclaimed",
    "bsd_liability": r"in no event shall .{1,120} be liable for any direct indirect incidental special exemplary or "
                     r"consequential damages.*",
    "isc_liability": r"in no event shall the author be liable for any special direct indirect or consequential "
                     r"damages.*",
    "gnu_free": r"(?:this program|this library|.{1,60}) is free software you can redistribute it and or modify it "
                r"under the terms of the gnu (?P<kind>lesser |affero )?general public license as published by the "
                r"free software foundation either version (?P<version>[23](?:\.[01])?) of the license or at your "
                r"option any later version",
    "gnu_only": r"(?:this program|this library|.{1,60}) is free software you can redistribute it and or modify it "
                r"under the terms of the gnu (?P<kind>lesser |affero )?general public license version "
                r"(?P<version>[23](?:\.[01])?) as published by the free software foundation",
    "gnu_hope": r".{1,60} is distributed in the hope that it will be useful but without any warranty without even "
                r"the implied warranty of merchantability or fitness for a particular purpose",
    "gnu_see": r"see the gnu (?:lesser |affero )?general public license for more details",
    "gnu_copy": r"you should have received a copy of the gnu (?:lesser |affero )?general public license along with "
                r".*",
    "mpl_copy": r"if a copy of the mpl was not distributed with this file you can obtain one at .*",
}
#: Ordered rules: (name, licence, sequence). "?" marks a sentence that may be absent.
RULES = (
    ("apache_header", "Apache-2.0", ("copyright?", "apache_licensed", "apache_comply", "apache_copy?", "apache_as_is", "apache_see?")),
    ("mit_text", "MIT", ("mit_short?", "copyright?", "mit_grant", "mit_notice", "mit_as_is?", "mit_liability?")),
    ("bsd3_text", "BSD-3-Clause", ("copyright?", "bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is?", "bsd_liability?")),
    ("bsd2_text", "BSD-2-Clause", ("copyright?", "bsd_redistribution", "bsd_source", "bsd_binary", "bsd_as_is?", "bsd_liability?")),
    ("isc_text", "ISC", ("copyright?", "isc_grant", "isc_as_is?", "isc_liability?")),
    ("gnu_header", "GNU", ("copyright?", "gnu_free", "gnu_hope?", "gnu_see?", "gnu_copy?")),
    ("gnu_only_header", "GNU", ("copyright?", "gnu_only", "gnu_hope?", "gnu_see?", "gnu_copy?")),
    ("mpl_header", "MPL-2.0", ("copyright?", "mpl_2", "mpl_copy?")),
    ("unlicense_text", "Unlicense", ("unlicense", "unlicense_grant?")),
    ("spdx_tag", "SPDX", ("copyright?", "spdx")),
    ("apache_line", "Apache-2.0", ("copyright?", "apache_short")),
    ("apache_first", "Apache-2.0", ("copyright?", "apache_licensed")),
    ("mit_line", "MIT", ("copyright?", "mit_short")),
    ("bsd_line", "BSD", ("copyright?", "bsd_short")),
    ("gnu_line", "GNU", ("copyright?", "gnu_short")),
    ("cc_line", "CC", ("copyright?", "cc_short")),
)

_LOOKUP = {v: k for k, v in SENTENCES.items()}
#: Every run of first words of a fixed sentence.
_PREFIXES = {" ".join(v.split()[:n]) for v in SENTENCES.values() for n in range(1, len(v.split()) + 1)}
_COMPILED = [(k, regex.compile(v)) for k, v in PATTERNS.items()]
_VERSION = re.compile(r"\bv(?:er(?:sion)?)? ?(?=[0-9])|\bversion +(?=[0-9])")
_STARTER = re.compile(r"\b(?:this (?:work|software|program|file|project|document|library)|licen[sc]ed|released|"
                      r"distributed|available under|under|permission (?:is|to)|redistribution|spdx|copyright|"
                      r"portions copyright|you (?:may|should)|neither the|see the|if a|in no|".replace(" ", r"[\W_]+")
                      + "|".join(sorted({r"[\W_]+".join(v.split()[:2]) for v in SENTENCES.values()})) + r")\b",
                      re.IGNORECASE)
_UNIT = re.compile(r"[^\n]*?(?:[.!?;:](?=\s|$)|(?=\n)|$)")
#: Words of the longest known sentence; a variable part has up to 120 characters, so 60 words.
LONGEST = max(*(len(v.split()) for v in SENTENCES.values()),
              *(len(v.split()) + 60 * len(re.findall(r"\.[*+{]", v)) for v in PATTERNS.values()))
_SINGLE = [k for k in KEYWORDS if " " not in k]
_WRAPPED = re.compile("|".join(k.replace(" ", "[^a-z0-9]+") for k in KEYWORDS if " " in k))
_KEYWORD = re.compile("|".join(k.replace(" ", "[^a-z0-9]+") for k in KEYWORDS))


def normalise(sentence: str) -> str:
    s = sentence.lower().replace("licence", "license")
    s = re.sub(r"[^a-z0-9.]+", " ", s)
    s = re.sub(r"\.(?![0-9])|(?<![0-9])\.", " ", s)
    s = _VERSION.sub("version ", s)
    return " ".join(s.split())


def identify(sentence: str) -> tuple[tuple[str, dict] | None, bool]:
    """Identifier and details of a normalised sentence, if it is known, and whether a known one
    can begin with these words."""
    if sentence in _LOOKUP:
        return (_LOOKUP[sentence], {}), True
    open_ = sentence in _PREFIXES
    for name, p in _COMPILED:
        m = p.fullmatch(sentence, partial=True)
        if m and not m.partial:
            return (name, {k: v.strip() for k, v in m.groupdict().items() if v}), True
        open_ = open_ or m is not None or p.fullmatch(sentence + " ", partial=True) is not None
    return None, open_


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of a text, without blank ones."""
    out, at = [], 0
    while at < len(text):
        m = _UNIT.match(text, at)
        end = m.end()
        if text[at:end].strip():
            out.append((at, end))
        at = end + 1 if end == at or text[end:end + 1] == "\n" else end
    return out


def _from(text: str, spans: list, plain: list[str], i: int, start: int) -> tuple | None:
    """The known sentence from ``start`` in unit i on, to the end of that or a later unit."""
    hit, joined = None, ""
    for j in range(i, len(spans)):
        end = spans[j][1]
        more = plain[j] if j > i or start == spans[i][0] else normalise(text[start:end])
        joined = f"{joined} {more}" if joined else more
        if j > i and more[0].isdigit():
            joined = _VERSION.sub("version ", joined)
        if joined.count(" ") > LONGEST + 1:
            break
        known, open_ = identify(joined)
        if known and (hit is None or known[0] != "copyright"):
            hit = (*known, start, end, i, j)
            if known[0] != "copyright":
                break
        if (j > i and hit) or not open_:
            break
    return hit


def _near_keywords(text: str, spans: list, plain: list[str]) -> list[bool]:
    """Whether a keyword stands in the LONGEST + 2 words from a unit's start on."""
    low = text.lower()
    if len(low) != len(text):                              # positions would not be the text's
        return [True] * len(spans)
    at = [m.start() for m in _KEYWORD.finditer(low)]
    words, out = [0], []
    for p in plain:
        words.append(words[-1] + p.count(" ") + 1)
    starts = [a for a, _ in spans]
    ahead = -1                                              # the unit that holds the next keyword
    for i in range(len(spans) - 1, -1, -1):
        while at and at[-1] >= starts[i]:
            ahead = bisect_right(starts, at.pop()) - 1
        out.append(ahead >= 0 and words[ahead] - words[i] <= LONGEST + 2)
    return out[::-1]


def sentences_of(text: str) -> list[tuple[str, dict, int, int, int, int]]:
    """Known sentences: (identifier, details, start, end, first unit, last unit), in order."""
    pairs = [(u, p) for u in units(text) if (p := normalise(text[u[0]:u[1]]))]
    spans, plain = [u for u, _ in pairs], [p for _, p in pairs]
    near = _near_keywords(text, spans, plain)
    found, i = [], 0
    while i < len(spans):
        start, end = spans[i]
        hit = _from(text, spans, plain, i, start) if near[i] else None
        for m in _STARTER.finditer(text, start, end) if hit is None and near[i] else ():
            hit = _from(text, spans, plain, i, m.start())
            if hit:
                break
        if hit:
            found.append(hit)
            i = hit[5] + 1
        else:
            i += 1
    return found


def _name(licence: str, details: dict) -> str:
    """The licence's identifier, with what the sentences say about kind and version."""
    if licence == "GNU":
        kind = {"lesser": "LGPL", "affero": "AGPL"}.get(details.get("kind", ""), "GPL")
        version = details.get("version", "")
        version = version if "." in version else f"{version}.0"
        return f"{kind}-{version}-{'or-later' if details.get('later') else 'only'}"
    if licence == "BSD":
        return f"BSD-{details['clauses']}-Clause"
    if licence == "CC":
        if details["terms"] in ("zero", "0"):
            return "CC0-1.0"
        return f"CC-{details['terms'].upper().replace(' ', '-')}-{details['version']}"
    if licence == "SPDX":
        return details["name"].upper().replace(" ", "-")
    return licence


def _take(rule: tuple, seen: list, at: int) -> int:
    """How many sentences of ``seen`` from ``at`` on the rule takes (0: no match)."""
    n, must = 0, 0
    for part in rule[2]:
        name = part.rstrip("?")
        i = at + n
        near = i < len(seen) and (n == 0 or seen[i][4] - seen[i - 1][5] - 1 <= MAX_GAP)
        if near and seen[i][0] == name:
            n += 1
            must += not part.endswith("?")
        elif not part.endswith("?"):
            return 0
    return n if must else 0


def scan_text(text: str | None) -> list[dict]:
    """Licences of a text: licence, rule, sentences, start, end (code points)."""
    if not text:
        return []
    low = text.lower()
    if not any(k in low for k in _SINGLE) and not _WRAPPED.search(low):
        return []
    seen = sentences_of(text)
    out, at = [], 0
    while at < len(seen):
        best, n = None, 0
        for rule in RULES:
            k = _take(rule, seen, at)
            if k > n:
                best, n = rule, k
        own = seen[at:at + max(1, n)]
        details: dict = {}
        for s in own:
            details.update(s[1])
        if best is not None and best[0] == "gnu_header":
            details["later"] = "any"
        out.append({"license": _name(best[1], details) if best else "unknown",
                    "rule": best[0] if best else own[0][0], "sentences": [s[0] for s in own],
                    "start": own[0][2], "end": own[-1][3]})
        at += len(own)
    return out


_SCHEMA = "license string, rule string, sentences array<string>, start long, end long"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, license, rule, sentences, start, end: a row for each licence found."""
    kind = docs.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, at = [], []
            for i, t in enumerate(b.column(1)):
                for r in scan_text(t.as_py()):
                    rows.append(r)
                    at.append(i)
            if rows:
                types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64())
                names = ("license", "rule", "sentences", "start", "end")
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types))],
                    names=["key", *names])

    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(run, f"key {kind}, {_SCHEMA}").withColumnRenamed("key", key))
