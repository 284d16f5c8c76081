"""Ranked lexical search by reversed search.

The items (queries) are few against the documents, so their terms make the inverted index:
term -> (item, weight). The index is put into every task, the documents stream through it once,
and each task keeps a bounded heap of the best documents per item. The heaps of all tasks are then
merged per item: at most ``k`` rows per item and task ever leave a task.

Scores are integer BM25 with these statistics over all documents: N the documents with a term,
L all their terms, n a document's terms, df the documents holding a term, tf its count in one::

    w(term)  = floor(1000 * ln((2N + 2) / (2 df + 1)))
    m(doc)   = 100 - 90 + (90 n N) div L
    score    = sum over the item's distinct terms of w * ((10^9 tf) div (1000 tf + 8 m))

Terms are maximal runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.
Corpus counts come from one pass: each task counts its documents' terms and the vocabulary's
document frequencies and sums them before the shuffle, so only the vocabulary's counts move.

The index is shipped only within ``posting_bound`` (term, item) entries. Beyond it the items are
dealt into blocks by a hash of their id, each within the bound, and the documents stream once per
block: the same method, with every item ranked against every document.

Defined cases: null or empty texts have no terms (they count in no statistic and are never
returned); a null ``item_id`` or repeated item rows form one item of all their terms; an item
without terms or with only terms that no document holds gets no rows; each document row is a
document, so repeated rows count twice and may both be returned; rows of null ``doc_id`` count in
the statistics but are not returned; equal scores go by ascending ``doc_id``; only scores above 0
are returned. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from statloom.llm.text import ascii_words, byte_texts, lower_ascii
from statloom.session import cut_lineage

# The term pattern and the integer constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K_SCALE, B_PART, SCALE, TF_SCALE, LENGTH_SCALE = 90, 100, 1_000_000_000, 1000, 8
POSTING_BOUND = 2_000_000

HIT_SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("score", T.LongType()),
    ]
)


def terms(text) -> F.Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), 0)


STATS_SCHEMA = T.StructType(
    [T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("words", T.LongType())]
)


def _counter(vocabulary: frozenset[bytes]):
    """Per task: documents with a term and their terms (one row, term null), and per vocabulary term
    the documents holding it; the task sums before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_words = 0
        held: Counter = Counter()
        for batch in batches:
            for text in byte_texts(batch):
                words = ascii_words(text)
                if words:
                    n_docs += 1
                    n_words += len(words)
                    held.update(vocabulary.intersection(words))
        terms_out = [None, *[t.decode() for t in held]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms_out, pa.string()), pa.array([n_docs, *held.values()], pa.int64()), pa.array([n_words] + [0] * len(held), pa.int64())],
            schema=pa.schema([("term", pa.string()), ("df", pa.int64()), ("words", pa.int64())]),
        )

    return count


def corpus_statistics(docs: DataFrame, vocabulary: DataFrame, bound: int = POSTING_BOUND) -> tuple[int, int, DataFrame]:
    """(N, L, df of the vocabulary's terms) over all documents, in one pass.

    Within ``bound`` terms the vocabulary goes to every task and each task counts its documents
    with the same word splitting as the scoring pass; beyond it every document's distinct terms
    meet the vocabulary by a join, summed map-side.
    """
    if vocabulary.count() <= bound:
        words = frozenset(r["term"].encode() for r in vocabulary.toLocalIterator())
        parts = docs.select("text").mapInArrow(_counter(words), STATS_SCHEMA)
        summed = cut_lineage(parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")))
        totals = summed.where(F.col("term").isNull()).first()
        held = summed.where(F.col("term").isNotNull() & (F.col("df") > 0)).select("term", "df")
        return int(totals["df"] or 0), int(totals["words"] or 0), held
    counted = docs.select(terms(F.col("text")).alias("t")).select(F.size("t").alias("n"), F.array_distinct("t").alias("t"))
    totals = counted.where(F.col("n") > 0).agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    held = counted.select(F.explode("t").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return int(totals["N"] or 0), int(totals["L"] or 0), held


def weights(n_docs: int, df: DataFrame) -> DataFrame:
    ratio = F.lit(2.0 * n_docs + 2.0) / (F.col("df").cast("double") * 2.0 + 1.0)
    return df.select("term", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("w"))


def item_postings(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of every item."""
    return items.select("item_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()


def _blocks(postings: DataFrame, bound: int) -> tuple[DataFrame, int]:
    """Deal items into blocks of at most ``bound`` postings (an item is never split)."""
    total = postings.count()
    blocks = max(1, math.ceil(total / bound))
    n_items = postings.select("item_id").distinct().count()
    while True:
        dealt = postings.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
        largest = dealt.groupBy("block").count().agg(F.max("count")).first()[0] or 0
        if largest <= bound or blocks >= n_items:
            return dealt, blocks
        blocks *= 2


def _scorer(index: dict[bytes, list[tuple[int | None, int]]], n_docs: int, n_words: int, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int | None, list[tuple[int, int]]] = {}
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for doc_id, text in zip(ids, byte_texts(batch)):
                words = ascii_words(text)
                if doc_id is None or not words:
                    continue
                m = B_PART - K_SCALE + (K_SCALE * len(words) * n_docs) // n_words
                sums: dict[int | None, int] = {}
                for term, tf in Counter(words).items():
                    postings = index.get(term)
                    if postings:
                        part = (SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m)
                        for item, w in postings:
                            sums[item] = sums.get(item, 0) + w * part
                for item, total in sums.items():
                    if total <= 0:
                        continue
                    heap = heaps.setdefault(item, [])
                    entry = (total, -doc_id)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        rows = [(item, -neg, total) for item, heap in heaps.items() for total, neg in heap]
        if rows:
            item_ids, doc_ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item_ids, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(scores, pa.int64())],
                schema=pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]),
            )

    return score


def rank(docs: DataFrame, items: DataFrame, k: int = 10, posting_bound: int = POSTING_BOUND) -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank (1 = best), doc_id, score."""
    postings = item_postings(items.select(F.col("item_id").cast("long").alias("item_id"), "text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = postings.select("term").distinct()
    n_docs, n_words, df = corpus_statistics(docs, vocabulary, posting_bound)
    spark = docs.sparkSession
    if n_words == 0:
        return spark.createDataFrame([], HIT_SCHEMA).withColumn("rank", F.lit(1)).select("item_id", "rank", "doc_id", "score")
    weighted = cut_lineage(postings.join(weights(n_docs, df), "term").where(F.col("w") > 0))
    dealt, blocks = _blocks(weighted, posting_bound)
    parts = []
    for block in range(blocks):
        index: dict[bytes, list[tuple[int | None, int]]] = {}
        for row in dealt.where(F.col("block") == block).select("term", "item_id", "w").toLocalIterator():
            index.setdefault(row["term"].encode(), []).append((row["item_id"], row["w"]))
        if index:
            parts.append(docs.mapInArrow(_scorer(index, n_docs, n_words, k), HIT_SCHEMA))
    if not parts:
        return spark.createDataFrame([], HIT_SCHEMA).withColumn("rank", F.lit(1)).select("item_id", "rank", "doc_id", "score")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '{TERM}') AS t
  FROM documents
), dl AS (SELECT rid, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
stats AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM dl),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term),
it AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM benchmark
), df AS (SELECT term, count(*)::BIGINT AS df FROM tf WHERE term IN (SELECT term FROM it) GROUP BY term),
w AS (
  SELECT term, floor(1000.0 * ln((2.0 * nn + 2.0) / (2.0 * df + 1.0)))::BIGINT AS w FROM df, stats
), scored AS (
  SELECT it.item_id, dl.doc_id,
         sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * dl.n * stats.nn) // stats.ll))))::BIGINT AS score
  FROM stats, it JOIN w USING (term) JOIN tf USING (term) JOIN dl USING (rid)
  WHERE dl.doc_id IS NOT NULL
  GROUP BY it.item_id, dl.rid, dl.doc_id
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
