"""Collocations, personal data and ranked search: against SQL, brute force and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from areastats.llm import fptree, phrases, pii
from areastats.llm.bilstm_crf import new_tagger, train
from areastats.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


def _duck(sql: str) -> list[tuple]:
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return sorted(c.sql(sql).fetchall())


@pytest.mark.parametrize("name", ["op11_collocations", "op13_ranked_search"])
def test_equals_sql(spark, name):
    got = QUERIES[name](spark, SF)
    assert sorted(map(tuple, got.collect())) == _duck(SQL[name])


# --- collocations ---------------------------------------------------------------------------

def _brute_phrases(rows, least=30, share=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(4, len(words) - i) + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        known = {p: c for p, c in counts.items() if c >= least}
        longest = Counter()
        for p, c in known.items():
            for k in range(2, len(p)):
                for s in range(len(p) - k + 1):
                    longest[p[s:s + k]] = max(longest[p[s:s + k]], c)
        rows = []
        for p, a in known.items():
            if len(p) > 1 and longest[p] * 100 < a * share:
                score, k = min((2_000_000 * a // (known[p[:k]] + known[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), known[p[:k]], known[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def _phrase_rows():
    rng = np.random.default_rng(3)
    words = ["Of", "the", "é", "日本", "new", "york", "a|b", "x\x0by", "c-d"]
    rows = []
    for i in range(60):
        body = " ".join(rng.choice(words, 80)) + ". New York city hall; new york\tcity hall\x00 "
        rows.append((body + "the the " * 20 + "end!", [None, "en", "fr", "und"][i % 4]))
    return rows + [(None, "en"), ("", None), (" \t.,", "en"), ("w" * 5000 + " " + "z" * 70, "en")] * 2


@pytest.mark.parametrize("routing", [{}, {"bucket_suffixes": 8}, {"sample_rows": 2}])
def test_collocations_equal_brute_force(spark, routing):
    rows = _phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = sorted(map(tuple, phrases.collocations(docs, least=5, top=50, **routing).collect()))
    assert got == _brute_phrases(rows, 5, top=50)


def test_collocations_hot_pairs(spark, monkeypatch):
    """A pair that would fill its bucket is spread over buckets by all four words; counts are whole."""
    rng = np.random.default_rng(4)
    rows = [("the same " + " the same ".join(f"w{i}" for i in rng.integers(0, 40, 50)), "en") for _ in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    seen = []
    own = phrases.materialise

    def watch(df, name):
        out = own(df, name)
        if name == "phrase-counts":
            seen.append(out.where("partial").count())
        return out

    monkeypatch.setattr(phrases, "materialise", watch)
    got = sorted(map(tuple, phrases.collocations(docs, least=5, top=500).collect()))
    assert got == _brute_phrases(rows, 5, top=500)
    assert seen[0] > 0                                        # the hot way was taken


class _Broadcast:
    def __init__(self, value):
        self.value = value


def _routed(texts, buckets, hot):
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["c0", "c1"])
    return phrases._route(buckets, _Broadcast(np.array(hot, np.uint64)))(iter([batch]))


@pytest.mark.parametrize("lines, spelled, chunk", [(1 << 17, 1 << 18, 1 << 20), (7, 16, 50), (1, 1, 3)])
def test_messages_in_pieces_lose_no_suffix(monkeypatch, lines, spelled, chunk):
    """However small the pieces that messages are written in, their lines and counts are those of the texts."""
    for name, value in (("_LINES", lines), ("_SPELLED", spelled), ("_CHUNK", chunk)):
        monkeypatch.setattr(phrases, name, value)
    texts = ["one two  one\ttwo three, one two one two three four", "é two. " * 9, "", "one " * 12 + "four" * 40]
    bytes_of = [np.frombuffer(w, np.uint8) for w in (b"one", b"two")]
    own = [phrases.word_hashes(d, np.array([0]), np.array([len(d)])) for d in bytes_of]
    got, want, by = Counter(), Counter(), Counter()
    for b in _routed(texts, 3, phrases._pair_hash(*own)):
        for bucket, hot, text, counts in zip(*(c.to_pylist() for c in b.columns[1:5])):
            if bucket is not None:
                for line, n in zip(text.decode().splitlines(), np.frombuffer(counts, "<i4").tolist(), strict=True):
                    got[line] += n
                    assert hot == line.startswith("one two")
                    by[line.split(" ")[0], line.split(" ")[1], bucket] += 0
    for t in texts:
        for piece in re.split("[.,;:!?]", t):
            words = re.findall("[^ \t]+", piece)
            want.update(" ".join(words[i:i + 4]) for i in range(len(words) - 1))
    assert got == want
    pairs = [p[:2] for p in by if p[:2] != ("one", "two")]
    assert len(pairs) == len(set(pairs))                      # other pairs have one bucket each
    payload, counts = "".join(f"{k}\n" for k in got).encode(), np.array(list(got.values()), "<i4").tobytes()
    raw, off, depth, total = phrases.count_lines([payload], [counts], (1,) * 4)
    exp = Counter()
    for k, n in want.items():
        for d in range(2, len(k.split(" ")) + 1):
            exp[" ".join(k.split(" ")[:d])] += n
    found = [raw[a:b].tobytes().decode() for a, b in zip(off, off[1:])]
    assert dict(zip(found, total.tolist(), strict=True)) == exp and len(found) == len(exp)
    assert [len(f.split(" ")) for f in found] == depth.tolist()


def test_messages_of_a_slice_stay_small():
    """A slice of eight megabytes is routed in a bounded multiple of its size."""
    import tracemalloc

    rng = np.random.default_rng(8)
    words = np.array([f"w{i:x}" for i in range(60_000)])
    texts = [" ".join(words[rng.integers(0, len(words), 5000)]) for _ in range(300)]
    size = sum(map(len, texts))
    assert 6 << 20 < size < 10 << 20
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in _routed(texts, 64, [1]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 0 and peak < 28 * size


def test_hashes_that_share_leading_bits():
    from areastats.llm._text import stable_order, unique_hashes

    rng = np.random.default_rng(9)
    for h in (rng.integers(0, 50, 1000), rng.integers(0, 1 << 62, 1000), rng.integers(0, 50, 300) << 40, np.zeros(0), np.ones(1)):
        h = np.asarray(h).astype(np.uint64)
        want = np.unique(h, return_index=True, return_inverse=True)
        assert all(np.array_equal(a, b) for a, b in zip(unique_hashes(h), want))
    codes = rng.integers(0, 9, 1000)
    for most in (9, 1 << 60):
        assert np.array_equal(stable_order(codes, most), np.argsort(codes, kind="stable"))


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(5)
    keys = rng.integers(1, 5, (400, 4))
    keys[rng.random(400) < 0.3, 3] = 0
    keys[(keys[:, 3] == 0) & (rng.random(400) < 0.5), 2] = 0
    weight = rng.integers(1, 4, 400).astype(float)
    exp = Counter()
    for row, w in zip(keys.tolist(), weight):
        for d in range(1, 5):
            if row[d - 1] == 0:
                break
            exp[tuple(row[:d])] += int(w)
    ptr, depth, total = phrases.quicksort(keys, weight, (9, 9, 9, 9))
    got = {tuple(keys[p][:d].tolist()): t for p, d, t in zip(ptr, depth, total.tolist())}
    assert got == {k: c for k, c in exp.items() if c >= 9} and len(got) == len(ptr)
    assert len(phrases.quicksort(keys[:0], weight[:0], (1, 1, 1, 1))[0]) == 0


def test_word_ids_survive_equal_hashes(monkeypatch):
    data = np.frombuffer(b"one two one six", np.uint8)
    starts, ends = np.array([0, 4, 8, 12]), np.array([3, 7, 11, 15])
    monkeypatch.setattr(phrases, "word_hashes", lambda d, s, e: np.ones(len(s), np.uint64))
    ids, first, _ = phrases.word_ids(data, starts, ends)
    assert ids[0] == ids[2] and len(set(ids.tolist())) == 3 and first.tolist() == [0, 1, 3]


def test_collocations_odd(odd, none):
    got = sorted(map(tuple, phrases.collocations(odd, least=2, top=10).collect()))
    assert got == _brute_phrases([(t, lang) for _, t, lang, *_ in ODD], 2, top=10)
    assert phrases.collocations(none).count() == 0


# --- personal data --------------------------------------------------------------------------

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _brute_pii(text):
    text, out = text or "", []
    for i, p in enumerate((_EMAIL, _IP, _CARD, _PHONE)):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, i == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and _luhn(d),
                  9 <= len(d) <= 15)[i]
            if ok:
                out.append((m.start(), i, m.end()))
    return [f"{pii.KINDS[i]}:{s}:{e}" for s, i, e in sorted(out)]


def _spans(text):
    return [f"{k}:{s}:{e}" for k, s, e in pii.base_spans(text)]


def test_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(6)
    alphabet = list("ab.@+-(){}0123456789 %_é\n") + ["@b.c", "1.2.3.4", "+1 555 ", "4111 1111 1111 1111", "256", "00"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert _spans(text) == _brute_pii(text), text
    for text in ("a@b.c@d.e", "a" * 200 + "@b.c", "1.2.3.4.5.6.7.8", "4111-1111 1111-1111", "0000000012.1.1.1", None, ""):
        assert _spans(text) == _brute_pii(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" + " " * 300_000, "a@" * 150_000):
        pii.base_spans(text)


def test_gradient_of_the_tagger():
    """The hand-written backward pass against finite differences."""
    rng = np.random.default_rng(1)
    tagger = new_tagger(*pii._legal(), emb=3, hidden=4)
    tagger.p = {k: v.astype(np.float64) if v.dtype == np.float32 else v for k, v in tagger.p.items()}
    ids, mask = rng.integers(1, 131, (3, 7)), np.arange(7) < np.array([[7], [5], [6]])
    tags = np.array([[0, 1, 2, 2, 0, 3, 4], [1, 2, 0, 0, 5, 0, 0], [0, 0, 7, 8, 8, 0, 0]])
    names = [n for n in tagger.p if not n.startswith("legal")]
    grads = {n: np.zeros(tagger.p[n].shape) for n in names}
    tagger.loss(ids, mask, tags, grads)
    for n in names:
        at = np.unravel_index(np.abs(grads[n]).argmax(), grads[n].shape)
        if n == "trans" and not tagger.p["legal"][at]:
            continue
        old, step, values = tagger.p[n][at], 1e-2, []
        for d in (step, -step):
            tagger.p[n][at] = old + d
            values.append(tagger.loss(ids, mask, tags, {k: np.zeros(tagger.p[k].shape) for k in names}))
        tagger.p[n][at] = old
        assert (values[0] - values[1]) / (2 * step) == pytest.approx(grads[n][at], rel=0.05, abs=2e-3), n


def test_train_learns():
    rng = np.random.default_rng(2)
    ids = rng.integers(97, 123, (60, 20))
    tags = np.zeros((60, 20), int)
    ids[:, 5:9], tags[:, 5], tags[:, 6:9] = 50, 1, 2
    mask = np.ones((60, 20), bool)
    tagger = new_tagger(*pii._legal(), hidden=8)
    losses = train(tagger, ids, mask, tags, steps=60, batch=20)
    assert losses[-1] < 0.1 * losses[0]
    assert (tagger.marginals(ids[:5], mask[:5]).argmax(axis=2) == tags[:5]).mean() > 0.95


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0")
    return pii.fit(docs, steps=250)


def test_tagger_finds_hidden_spans_in_unseen_texts(spark, tagger):
    """Half of the documents taught; spans of the other half are rewritten and must be found."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1").collect()
    texts, wanted = [], []
    for r in rows:
        spans = [s for s in pii.base_spans(r.text) if s[1] > 40 and s[2] < len(r.text) - 40]
        if spans and len(texts) < 150:
            kind, s, e = spans[0]
            new = pii._hide(kind, r.text[s:e], r.doc_id)
            texts.append(r.text[s - 40:s] + new + r.text[e:e + 40])
            wanted.append((f"near_{kind}", 40, 40 + len(new)))
    found = [[(x["kind"], x["start"], x["end"]) for x in spans] for spans in pii.spans_of(texts, tagger, 0.9)]
    assert np.mean([any(k == w[0] and s < w[2] and w[1] < e for k, s, e in f) for f, w in zip(found, wanted)]) > 0.7
    clean = [r.text for r in rows if r.text and not pii.base_spans(r.text)][:1500]
    assert np.mean([bool(s) for s in pii.spans_of(clean, tagger, 0.97)]) < 0.01


def test_windows_are_reconciled(tagger):
    """A text of many overlapping windows has the spans of its parts, none twice, base ones whole."""
    part = "see ab.07@mail3.example.com or +1 (425) 555-0142 and 10.20.30.40 there; "
    text = part * 30
    spans = pii.spans_of([text], tagger, 0.97)[0]
    base = [s for s in spans if s["kind"] in pii.KINDS]
    assert len(base) == 90 and [f"{s['kind']}:{s['start']}:{s['end']}" for s in base] == _brute_pii(text)
    ordered = [(s["start"], s["end"]) for s in spans]
    assert ordered == sorted(ordered) and all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))


def test_personal_data_odd(spark, odd, none, tagger):
    extra = spark.createDataFrame([(70, "mail ab@c.de now"), (70, "mail ab@c.de now"), (None, "é ab@c.de")],
                                  "doc_id long, text string")
    rows = pii.digest(odd.unionByName(extra, allowMissingColumns=True), tagger).collect()
    assert len(rows) == len(ODD) + 3 and sum(r.n_email for r in rows) == 3
    texts = [t for _, t, *_ in ODD] + ["mail ab@c.de now"] * 2 + ["é ab@c.de"]
    exp = Counter(hashlib.sha256(",".join(_brute_pii(t)).encode()).hexdigest() for t in texts)
    assert Counter(r.base_sha256 for r in rows) == exp
    assert pii.digest(none, tagger).count() == 0 and pii.digest(odd, None).count() == len(ODD)
    assert pii.fit(none) is None and pii.fit(odd.where("doc_id = 1")) is None


def test_op12_base_equals_brute_force(spark, tagger):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.digest(docs, tagger).collect():
        exp = _brute_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(exp).encode()).hexdigest()
        assert set(exp) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in exp) for k in pii.KINDS]


# --- ranked search --------------------------------------------------------------------------

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute_search(docs, items, k=10):
    """(doc id, text) and (item id, text) lists; ids may be null or repeated."""
    vectors = [(d, Counter(_terms(t))) for d, t in docs]
    vectors = [(d, c, sum(c.values())) for d, c in vectors if c]
    total, length = len(vectors), sum(n for *_, n in vectors)
    df = Counter(t for _, c, _ in vectors for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in vectors:
            m = 25 + 75 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in _terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if missing else d, -s) for r, (s, missing, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _search_rows(n=400):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)] + ["Émile", "日本語", "x_y"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda size: " ".join(rng.choice(words, size, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(n)]
    docs += [(d, t) for d, t in docs[:50]] + [(n + i, docs[7][1]) for i in range(60)]
    docs += [(None, docs[9][1]), (None, None), (n + 99, ""), (n + 98, text(5000)), (3, "unlike all others")]
    items = [(i, text(12)) for i in range(9)] + [(20, None), (21, ""), (22, "not there"), (23, "W1 w1 w2!w2 émile")]
    return docs, items


@pytest.mark.parametrize("trie_docs, group", [(1 << 14, 1 << 12), (37, 4)])
def test_search_equals_brute_force(spark, monkeypatch, trie_docs, group):
    monkeypatch.setattr(fptree, "TRIE_DOCS", trie_docs)
    docs, items = _search_rows()
    got = fptree.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                        spark.createDataFrame(items, "item_id long, text string"), item_group=group)
    got = sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == _brute_search(docs, items)


def test_trie_bounds_leave_subtrees():
    """Branch and bound: far fewer documents are scored than there are, with the exact result."""
    rng = np.random.default_rng(9)
    n, terms = 3000, 400
    vectors = [np.unique(rng.zipf(1.3, 30) % terms) for _ in range(n)]
    df = dict(Counter(int(t) for v in vectors for t in v))
    wanted = [list(map(int, rng.choice(list(df), 8))) for _ in range(5)]
    items = fptree.Items(wanted, df, n)
    m = rng.integers(80, 120, n)
    ranks = [np.sort(items.ranks(v)) for v in vectors]
    start = np.concatenate(([0], np.cumsum([len(r) for r in ranks])))
    tf = rng.integers(1, 4, start[-1])
    trie = fptree.Trie(start, np.concatenate(ranks), tf, m)
    best = fptree.Best(len(wanted), 10)
    ids = list(range(n))
    scored = fptree.search_trie(trie, items, best, ids, [(False, i) for i in ids])
    for i in range(len(wanted)):
        worth = dict(zip(items.term[items.item == i], items.worth[items.item == i]))
        exp = []
        for d in range(n):
            g = fptree.gain(tf[start[d]:start[d + 1]], m[d])
            s = sum(int(worth.get(r, 0)) * int(x) for r, x in zip(ranks[d], g))
            exp.append((-s, d))
        got = sorted((-s, key) for s, _, key in best.heaps[i])
        assert got == sorted(x for x in exp if x[0] < 0)[:10]
    assert scored < n / 2
    prefix = set()
    for r in ranks:
        prefix |= {tuple(r[:j].tolist()) for j in range(len(r) + 1)}
    assert len(trie.first) <= min(len(prefix), 2 * n + 1)     # paths without a fork are one node


def test_norm_is_exact_beyond_64_bits():
    n = np.array([10 ** 9, 7], np.int64)
    assert fptree.norm(n, 10 ** 11, 10 ** 13).tolist() == [25 + 75 * x * 10 ** 11 // 10 ** 13 for x in (10 ** 9, 7)]


def test_search_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (None, "one text"), (2, None), (1, "日本語のテキスト　と　全角の空白")],
                                  "item_id long, text string")
    rows = fptree.search(odd, items).collect()
    docs = [(d, t) for d, t, *_ in ODD]
    exp = _brute_search(docs, [(1, "quick brown fox"), (None, "one text"), (1, "日本語のテキスト　と　全角の空白")])
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str) == exp
    assert {(r.item_id, r["list"]) for r in rows} == {(1, 0), (1, 1), (None, 0)}
    assert fptree.search(none, items).count() == 0 and fptree.search(odd, items.where("false")).count() == 0
    assert fptree.search(odd.withColumn("doc_id", F.col("doc_id").cast("string")), items).count() == len(rows)
