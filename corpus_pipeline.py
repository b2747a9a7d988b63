"""From raw documents to packed training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's
result as Parquet under the shared folder and reads it again as the next stage's input. All
but the last return the columns of ``documents``:

1. ``quality``: documents that the quality classifier rejects go (fitted on the labelled ones).
2. ``near_duplicates``: one document of each class of near duplicates stays, of the smallest id.
3. ``decontamination``: documents in which a benchmark item is found go.
4. ``secrets``: every secret in a text is replaced by its kind in brackets; ``n_chars`` follows.
5. ``packing``: doc_id, n_tokens, bucket, bucket_len, batch, padding of every document left.

Rows with null ids or texts pass through a stage as its operator states; an empty table gives
an empty result. Extra columns of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areastats.llm import decontaminate, near_dup, packing, quality, secrets
from areastats.llm._spark import free_name, materialise, ship, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All labelled documents of the input are learned from: nothing is held out here."""
    ship(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    given = docs.columns                              # columns named like the operator's, in any case, step aside
    aside = docs
    for c in given:
        if c.lower() in ("score", "predicted"):
            aside = aside.withColumnRenamed(c, free_name(aside, f"_in_{c}"))
    kept = quality.score(aside, model).where("predicted = 1").drop("score", "predicted")
    return kept.toDF(*given)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: A trained classifier and weighted sampling are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
