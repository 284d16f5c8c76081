"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of ``documents``. A row is found again by its id and a hash of id and text, so
repeated and null ids do no harm; rows of equal id and text are one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statloom.llm import bpe, crf_langid, decontaminate, jaccard_join, line_dedup
from statloom.llm.text import held_out, table
from statloom.session import scratch_path

LEAST_SCORE = 0.5


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def without(docs: DataFrame, losers: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not among ``losers`` (doc_id, __row)."""
    gone = losers.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__gone")).distinct()
    same = (F.col("__row") == F.col("__gone")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return docs.withColumn("__row", row_key()).join(gone, same, "left_anti").drop("__row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or of a mixed-up language go.

    An empty table stays empty; where no row has a language nothing can be told, and nothing goes.
    """
    model = crf_langid.train(docs.where(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs
    labelled = crf_langid.label_texts(docs, model, keep=True)
    sure = (F.col("lang_pred") != crf_langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return labelled.where(sure).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of any number of lines; a document of which nothing else is left goes."""
    done = line_dedup.dedup_lines(docs, max_lines=None)
    left = (F.col("n_deleted") == 0) | (F.trim("text") != "")
    kept = done.where(F.coalesce(left, F.lit(True)))
    count = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", count).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group: the smallest id, then the smallest hash; empty texts stay."""
    found = jaccard_join.near_duplicates(docs).where("n_shingles > 0")
    key = ["doc_id", "__row"]
    first = found.groupBy("component_id").agg(F.min(F.struct(*key)).alias("first"))
    same = F.col("component_id").eqNullSafe(F.col("c"))
    losers = found.join(first.withColumnRenamed("component_id", "c"), same).where(~F.struct(*key).eqNullSafe(F.col("first")))
    kept = without(docs, losers).withColumn("__row", row_key())
    return kept.dropDuplicates(key).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, leaks.where("contaminated"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the documents' other columns."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_texts(docs, path, public_tokenizers.PATTERN, keep_others=True)
    return encoded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# Training and encoding are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
