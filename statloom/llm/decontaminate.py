"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ten consecutive words of an item (a shorter item is one window). A document can hold a
window only if it holds the window's rarest word, so that word is the window's whole necessary
prefix: containment asks for all ten of ten tokens. Words are ranked by their count over all
documents. Document places that carry a prefix word, with the words around them, are joined with the
windows on that word; the place must leave room for the window on both sides, and then the words are
compared in order. Only DataFrame functions are used.

The benchmark is the bounded side: it is taken in blocks of at most ``block`` windows, each of which
is broadcast, so a large benchmark means more passes and never a larger broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from statloom.llm.text import lower_ascii

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    split = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(split, lambda w: w != "")


def item_windows(items: DataFrame, window: int, item_column: str, text_column: str) -> DataFrame:
    """(item, words, size): the distinct windows of every item that has a word."""
    words = items.select(F.col(f"`{item_column}`").cast("string").alias("item"), words_of(F.col(f"`{text_column}`")).alias("all"))
    size = F.least(F.size("all"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("all") - size + 1)
    return (
        words.where(F.size("all") > 0)
        .select("item", size.alias("size"), "all", F.explode(starts).alias("start"))
        .select("item", "size", F.slice("all", F.col("start"), F.col("size")).alias("words"))
        .distinct()
    )


def with_prefix(windows: DataFrame, docs: DataFrame, text_column: str, bound: int = 200_000) -> DataFrame:
    """Each distinct run of words with its items, its rarest word and where in it that word stands first.

    Counts cover every document. The vocabulary of the benchmark is broadcast only while it is within
    ``bound`` words, else it is joined by a shuffle.
    """
    runs = windows.groupBy("words", "size").agg(F.collect_set("item").alias("items"))
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    if vocabulary.count() <= bound:
        vocabulary = F.broadcast(vocabulary)
    counts = (
        docs.select(F.explode(words_of(F.col(f"`{text_column}`"))).alias("word"))
        .join(vocabulary, "word")
        .groupBy("word")
        .agg(F.count("*").alias("count"))
    )
    placed = windows.select("words", F.posexplode("words").alias("offset", "word")).distinct()
    first = (
        placed.join(counts, "word", "left")
        .groupBy("words")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "offset")).alias("rarest"))
    )
    return runs.join(first, "words").select(
        "words", "size", "items", F.col("rarest.word").alias("prefix"), F.col("rarest.offset").alias("offset")
    )


def _place(words: Column, at: Column, reach: int) -> Column:
    """The word at a place with up to ``reach`` words on either side."""
    before = F.least(at, F.lit(reach))
    return F.struct(
        at.alias("at"),
        F.get(words, at).alias("word"),
        before.alias("before"),
        F.slice(words, at - before + 1, before + reach + 1).alias("around"),
    )


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = 10,
    block: int = 20_000,
) -> DataFrame:
    """One row per document row: id, __row, n_words, places (start, size), items, n_hit, contaminated.

    ``__row`` is a hash of id and text, by which texts can be joined again. A word inside any occurrence
    of a window counts once in ``n_hit``; ``items`` are the sorted ids, as strings, of items with an
    occurring window. Null and empty documents have no words; null and empty items have no windows;
    repeated items and rows count as they stand; null ids are ids like any other. With no items nothing
    is contaminated. Other columns are not looked at.
    """
    found = with_prefix(item_windows(items, window, item_column, item_text_column), docs, text_column)
    # one row a window of the benchmark, in blocks from here on
    rows = sorted((r["prefix"], r["offset"], r["words"], r["size"], r["items"]) for r in found.toLocalIterator())
    blocks = [rows[i : i + block] for i in range(0, len(rows), block)] or [[]]
    schema = "prefix string, offset int, words array<string>, size int, items array<string>"
    text = F.col(f"`{text_column}`")
    marked: list[DataFrame] = []
    for number, held in enumerate(blocks):
        windows = docs.sparkSession.createDataFrame(held, schema)
        prefixes = sorted({h[0] for h in held})
        reach = max([h[3] for h in held], default=1) - 1

        at = F.filter(
            F.transform(F.col("__words"), lambda w, i: F.when(w.isin(prefixes), i)) if prefixes else F.array(),
            lambda i: i.isNotNull(),
        )
        marker = F.struct(
            F.lit(-1).alias("at"),
            F.lit(None).cast("string").alias("word"),
            F.lit(0).alias("before"),
            F.array().cast("array<string>").alias("around"),
        )
        words = F.col("__words")
        places = F.transform(at.cast("array<int>"), lambda i: _place(words, i, reach))  # noqa: B023
        source = docs.select(
            F.col(f"`{id_column}`").alias("__id"),
            F.xxhash64(F.col(f"`{id_column}`"), text).alias("__row"),
            words_of(text).alias("__words"),
        )
        candidates = source.select(
            "__id", "__row", F.size("__words").alias("n_words"), F.explode(F.concat(F.array(marker), places)).alias("c")
        )
        if number:
            candidates = candidates.where("c.at >= 0")
        start = F.col("c.before") - F.col("offset")
        fits = (
            (F.col("c.word") == F.col("prefix"))
            & (start >= 0)
            & (F.size("c.around") >= start + F.col("size"))
            & (F.slice("c.around", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("words"))
        )
        marked.append(
            candidates.join(F.broadcast(windows), fits, "left")
            .where("c.at < 0 OR prefix IS NOT NULL")
            .select(
                "__id",
                "__row",
                "n_words",
                F.when(F.col("c.at") < 0, 1).otherwise(0).alias("mark"),
                F.when(
                    F.col("c.at") >= 0, F.struct((F.col("c.at") - F.col("offset")).alias("start"), F.col("size"))
                ).alias("place"),
                "items",
            )
        )
    grouped = (
        reduce(DataFrame.unionAll, marked)
        .groupBy("__id", "__row", "n_words")
        .agg(
            F.sum("mark").cast("int").alias("__rows"),
            F.array_sort(F.collect_set("place")).alias("places"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    inside = F.flatten(
        F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["size"] - 1))
    )
    return (
        grouped.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__rows"))))
        .select(
            F.col("__id").alias(id_column),
            "__row",
            F.col("n_words").cast("long").alias("n_words"),
            "places",
            "items",
            F.size(F.array_distinct(inside)).cast("long").alias("n_hit"),
            (F.size("places") > 0).alias("contaminated"),
        )
    )


UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '{WORD}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM iw),
dw AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
