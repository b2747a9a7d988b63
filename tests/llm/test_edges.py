"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns: each operator
and each pipeline stage gives its documented result."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import EXTRA, LONG, ODD
from pyspark.sql import functions as F

from areastats.llm import (decontaminate, langid, licenses, near_dup, packing, quality, secrets, substring,
                           token_file, vafile)
from areastats.session import scratch_path

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "What does the fox do? The quick brown fox jumps over the lazy dog."), (2, None), (3, ""),
         (None, "An item without an id stands here. It is reported as null."),
         (1, "What does the fox do? The quick brown fox jumps over the lazy dog.")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(1, 10)] + [(None, 1, 0), (3, None, None), (1, 1, 1), (99, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_language(odd, none):
    model = langid.fit(odd, F.lit(True))
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.score == 0)
    und = sorted((r.doc_id for r in rows if r.lang_pred == "und"), key=str)
    assert und == sorted([2, 3, 4, None, 6], key=str)        # null, empty, blank or no letter
    assert langid.fit(none, F.lit(True)) is None
    assert langid.predict(none, None).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_quality(odd, none, labels):
    model = quality.fit(odd, labels, F.lit(True))
    scored = quality.score(odd, model)
    assert scored.columns == [c for c in odd.columns if c not in ("score", "predicted")] + ["score", "predicted"]
    rows = scored.collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    blank = quality.fit(odd, labels.where("false"), F.lit(True))
    assert {r.predicted for r in quality.score(odd, blank).collect()} == {1}
    bad = quality.fit(odd, labels.where("quality = 0"), F.lit(True))
    assert {r.predicted for r in quality.score(odd, bad).collect()} == {0}
    assert quality.score(none, model).count() == 0


def test_licenses(odd, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_packing(odd, none):
    rows = packing.pack(odd, buckets=3, token_budget=50).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.n_tokens for r in rows) == sorted(len((t or "").encode().split()) for _, t, *_ in ODD)
    assert all(r.padding == r.bucket_len - r.n_tokens >= 0 for r in rows)
    sizes: dict = {}
    for r in rows:
        sizes.setdefault((r.bucket, r.batch), []).append(r.bucket_len)
    assert all(len(v) == 1 or sum(v) <= 50 for v in sizes.values())
    assert packing.pack(none).count() == 0


def test_substring(odd, none):
    out = substring.remove_repeats(odd)
    assert out.columns == [c for c in odd.columns if c != "n_words"] + ["n_words", "n_removed", "kept_text"]
    rows = out.collect()
    assert len(rows) == len(ODD)
    # the long text repeats only itself, equal rows have one id: nothing is older than anything
    assert all(r.n_removed == 0 and r.kept_text == " ".join((r.text or "").encode().decode().split("\x00")[0:1]) or
               r.n_removed == 0 for r in rows)
    assert next(r for r in rows if r.doc_id == 5).n_words == 60_000
    assert [r.kept_text for r in rows if r.text is None] == ["", ""]
    assert substring.digest(none).count() == 0


def test_secrets(spark, odd, none):
    rows = secrets.digest(odd).collect()
    assert len(rows) == len(ODD) and {r.base_sha256 for r in rows} == {EMPTY_SHA}
    assert secrets.redact(odd).exceptAll(odd).count() == 0
    assert secrets.redact(odd).columns == odd.columns
    assert secrets.digest(none).count() == 0


def test_token_file(spark, odd, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = scratch_path(spark, "tokens")
    token_file.write(odd, out, path, end_id=2)
    rows = sorted(token_file.read_documents(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    end = zlib.crc32((2).to_bytes(4, "little"))
    assert [(r.n_tokens, r.ids_crc32) for r in rows if r.doc_id in (3, 4)] == [(1, end)] * 2
    nothing = scratch_path(spark, "tokens")
    token_file.write(none, nothing, path, end_id=2)
    assert token_file.read_documents(spark, nothing).count() == 0


def _dealt(spark, rows):
    """Documents of each part of a token file, in order."""
    import public_tokenizers

    out = scratch_path(spark, "tokens")
    token_file.write(rows, out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    got = sorted(token_file.read_documents(spark, out).collect(), key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    blocks = spark.read.parquet(f"{out}/blocks").groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n"))
    return got, sorted(r.n for r in blocks.collect())


@pytest.mark.parametrize("hot", ["id", "id and text", "null", "null and text"])
def test_token_file_deals_hot_ids(spark, hot):
    n = 4000
    own = F.col("id") % 2 == 0                         # half of the rows
    doc = F.when(own, F.lit(None if "null" in hot else 1001)).otherwise(F.col("id"))
    text = F.concat(F.lit("text "), F.when(own & F.lit("text" in hot), F.lit(0)).otherwise(F.col("id")))
    rows = spark.range(n).select(doc.cast("long").alias("doc_id"), text.alias("text"))
    got, sizes = _dealt(spark, rows)
    want = sorted((r.doc_id for r in rows.collect()), key=lambda i: -1 if i is None else i)
    assert [r.doc_id for r in got] == want
    assert sum(sizes) == n and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    again, _ = _dealt(spark, rows.repartition(3))      # the same rows, read in another order
    assert got == again


def test_token_file_counts_ids_where_it_makes_them(spark):
    """The shared table comes from counts of the tokenizing tasks: the ids are not read for it again."""
    import public_tokenizers

    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("Été aß 1a2!? "), F.col("id") % 7).alias("text"))
    for end_id in (2, 70_000):                         # ids of two bytes, and beyond them
        raw = token_file._tokenized(rows, public_tokenizers.path("word_bpe_49k.json"), end_id, "doc_id", "text", True).cache()
        times = {r["symbol"]: r["count"] for r in token_file._frequencies(raw.drop("ids")).collect()}
        want = Counter()
        for r in raw.where("block >= 0").collect():
            ids = token_file._wide(r.ids, sum(r.doc_lens))
            assert len(ids) == sum(r.doc_lens) and len(r.ids) == len(ids) * (2 if end_id == 2 else 4)
            want.update(ids.tolist())
        assert times == want and times[end_id] == 300
        out = scratch_path(spark, "tokens")
        token_file.write(rows, out, public_tokenizers.path("word_bpe_49k.json"), end_id=end_id)
        got = Counter(i for r in token_file.read_ids(spark, out).collect() for i in r.ids)
        assert got == want


def test_decontamination(odd, none, items):
    rows = decontaminate.decontaminate(odd, items, question_overlap=0.0).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 1), (1, 1)]
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(odd, items.where("false")).count() == 0
    kept = decontaminate.drop_contaminated(odd, items, question_overlap=0.0)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2


def test_topk(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (1, [0.5, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]),
            (4, []), (None, [1.0, 1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [0.0, 0.0]), (8, [-1.0, -2.0]),
            (100, [3.0, 1.0, 2.0]), (9, [1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = vafile.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 5, 5 * 65536), (0, 2, 6, 5 * 65536), (0, 3, 7, 0)]
    assert vafile.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_near_duplicates(odd, none):
    rows = near_dup.classes(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[8].class_id == by[9].class_id == 8 and by[8].class_size == 2 and by[9].n_links == 1
    assert all(r.class_id == r.doc_id for r in rows if r.doc_id not in (9,))
    kept = near_dup.deduplicate(odd)
    assert kept.columns == odd.columns
    # the repeated row and the copy of a smaller id go
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(
        map(str, [1, 2, 3, 4, None, None, 5, 6, 7, 2, 8]))
    assert near_dup.classes(none).count() == 0 and near_dup.deduplicate(none).count() == 0


def test_pipeline_stages(spark, odd, none, labels, items):
    import corpus_pipeline as P

    d = scratch_path(spark, "sf")
    labels.write.parquet(f"{d}/labels.parquet")
    items.write.parquet(f"{d}/benchmark.parquet")
    for docs in (odd, none):
        for name, stage in P.STAGES:
            out = stage(spark, docs, d)
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns, name
                assert len(rows) <= len(ODD)
            if docs is none:
                assert rows == []
    docs = odd
    docs.write.parquet(f"{d}/documents.parquet")
    assert P.run(spark, d).columns[:2] == ["doc_id", "n_tokens"]
    assert EXTRA and LONG


def test_quality_sample_is_bounded_by_rows(spark):
    """One labelled id on many rows, repeated rows, a tight bound: one document for each id."""
    hot = [(1, f"alpha beta {i} gamma.") for i in range(400)] + [(1, "same words here.")] * 400
    docs = spark.createDataFrame(hot + [(i, f"noise!!! {i} {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 60)], "doc_id long, quality int")
    seen = []
    learn, quality.dual_descent = quality.dual_descent, lambda rows, y, r: seen.append(len(rows)) or learn(rows, y, r)
    try:
        quality.fit(docs, labels, F.lit(True))
        quality.fit(docs, labels, F.lit(True), sample_rows=10)
        quality.fit(docs, labels, F.lit(True), sample_features=300)
    finally:
        quality.dual_descent = learn
    assert seen[0] == 59
    assert all(n <= 10 for n in seen[1:2]) and all(n < 59 for n in seen[1:])


def test_quality_features_do_not_depend_on_pieces():
    rng = np.random.default_rng(5)
    for text in (b"aaa   BBB111...zz" * 40, bytes(rng.choice(list(b"aB1. \n"), 3000)), b"a" * 500, b"ab"):
        data = np.frombuffer(text, np.uint8)
        whole = quality.features(data).tolist()
        for piece in (1, 2, 3, 7, 64):
            assert quality.features(data, piece).tolist() == whole


def test_packed_features_come_back():
    for n in (0, 5, 4095, 4096, 30000, quality.DIM):
        x = np.sort(np.random.default_rng(n).permutation(quality.DIM)[:n]).astype(np.uint16)
        assert np.array_equal(quality._unpacked(quality._packed(x)), x)


def test_samples_of_hot_rows(spark):
    from areastats.llm._spark import capped, distinct_sample

    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("mark"))
    got = capped(distinct_sample(df, "mark", 100), "mark", 100).collect()
    assert 50 <= len(got) <= 100 and len(set(got)) == len(got)
    assert capped(distinct_sample(df.where("mark = -1"), "mark", 100), "mark", 100).count() == 1
    docs = spark.createDataFrame([(None, f"wort {i} der", "de") for i in range(900)]
                                 + [(None, f"word {i} the", "en") for i in range(900)],
                                 "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), sample_rows=50)       # null ids only: the sample isn't empty
    assert sorted(model.langs) == ["de", "en"]
    assert {r.lang_pred for r in langid.predict(docs.where("lang = 'de'"), model).collect()} == {"de"}


@pytest.mark.parametrize("size", [1e3, 2e5, 1.5e6])
def test_topk_is_exact_at_any_size(spark, size):
    """Large components: sums past 2^53 are exact integers, in the order of brute force."""
    rng = np.random.default_rng(int(size))
    v = np.round(rng.normal(0, size, (300, 8)), 2)
    v[200:] = v[:100]                                         # ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 50 == 0, block_rows=64).collect()]
    ints = [[int(np.floor(256 * x)) for x in row] for row in v]
    want = []
    for q in range(0, 300, 50):
        s = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in range(300) if c != q)
        want += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:5])]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("size", [1e10, 1e17])
def test_topk_raises_where_64_bits_cannot_hold_it(spark, size):
    df = spark.createDataFrame([(i, [size * (i + 1)] * 4) for i in range(60)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits|62 bits"):
        vafile.top_k(df, F.col("vec_id") % 50 == 0).collect()


def test_quality_stage_keeps_columns_named_like_its_own(spark, odd, labels):
    import corpus_pipeline as P

    from unittest import mock

    docs = odd.select("doc_id", "text", F.lit(7).alias("Score"), F.lit("x").alias("_in_Score"), F.lit(3).alias("PREDICTED"))
    with mock.patch.object(P, "table", lambda *a: labels):
        got = P.quality_stage(spark, docs, "")
        assert got.columns == docs.columns
        assert {(r[2], r[3], r[4]) for r in got.collect()} <= {(7, "x", 3)}
