"""The queries of this package, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (decontaminate, fptree, langid, licenses, near_dup, packing, phrases, pii, quality, secrets, substring,
               token_file, vafile)
from ._spark import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs, ~out)
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score",
                                              "ambiguous")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~out)
    return (quality.score(docs.select("doc_id", "text"), model)
            .select("doc_id", out.alias("held_out"), "score", "predicted"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_token_file(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """``tokenizer``: the path of a tokenizer file that every executor has."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = scratch_path(spark, "token-file")
    token_file.write(table(spark, sf_dir, "documents"), path, tokenizer, end_id=2)
    return token_file.read_documents(spark, path)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vafile.top_k(rows, F.col("vec_id") % 50 == 0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.fit(docs))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (fptree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
            .select("item_id", "rank", "doc_id", "score"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_quality, op3_licenses, op4_packing, op5_repeats, op6_secrets, op7_token_file, op8_decontamination, op9_topk,
    op10_near_duplicates, op11_collocations, op12_personal_data, op13_ranked_search)}
SQL: dict[str, str] = {"op4_packing": packing.SQL, "op5_repeats": substring.SQL, "op9_topk": vafile.SQL,
                       "op11_collocations": phrases.SQL, "op13_ranked_search": fptree.SQL}
