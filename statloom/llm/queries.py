"""Registered queries of the operators, each over its whole tables, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from statloom.llm import (
    bpe,
    chat_format,
    conversation_repair,
    crf_langid,
    decontaminate,
    html_extract,
    jaccard_join,
    license_scan,
    line_dedup,
    pu_toxicity,
    ranked_search,
    topk,
    url_filter,
)
from statloom.llm.text import held_out, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


def op6_line_dedup_whole_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs, max_lines=None, whole_runs=True)
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.train(pages)).drop("blocks")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crf_langid.train(docs.where(~held_out(F.col("doc_id"))))
    labelled = crf_langid.label_texts(docs.select("doc_id", "text"), model)
    return labelled.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learnable = ~held_out(F.col("doc_id"))
    model = pu_toxicity.train(docs.where(learnable), labels.where(learnable))
    scored = pu_toxicity.score_texts(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filter": op5_url_filter,
    "op6_line_dedup": op6_line_dedup,
    "op6_line_dedup_whole_runs": op6_line_dedup_whole_runs,
    "op7_decontaminate": op7_decontaminate,
    "op8_top_k": op8_top_k,
    "op9_html_extract": op9_html_extract,
    "op10_language_id": op10_language_id,
}

ORACLES = {
    "op5_url_filter": url_filter.verdict_sql("pages"),
    "op6_line_dedup": line_dedup.ORACLE,
    "op6_line_dedup_whole_runs": line_dedup.RUNS_ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_top_k": topk.ORACLE,
}


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    probe = spark.createDataFrame([(-1, 0, "user", chat_format.PROBE), (-1, 1, "assistant", chat_format.PROBE)], conversations.schema)
    back = chat_format.read_back(chat_format.format_examples(conversations.unionByName(probe)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    done = conversation_repair.repair(conversation_repair.damage(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(done, every["conv_id"].eqNullSafe(done["conv_id"]), "left").drop(done["conv_id"])
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(F.col("audit"), F.lit("")).alias("audit"),
        F.sha2(F.coalesce(F.array_join(lines, "\n"), F.lit("")), 256).alias("repaired_sha256"),
    )


QUERIES |= {
    "op11_chat_format": op11_chat_format,
    "op12_ranked_search": op12_ranked_search,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES |= {
    "op11_chat_format": chat_format.ORACLE,
    "op12_ranked_search": ranked_search.ORACLE,
}
