"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all training texts, the toxic ones among them, stand as
unlabelled. With the class prior p, the risk of a classifier is p * (risk of positives as positive) plus the
risk of unlabelled as negative less p * (risk of positives as negative). The latter part estimates the
risk of the clean texts, which cannot be negative; where it turns negative the fit steps back
(non-negative correction), so that it does not learn the positives by heart.

The model is linear over the presence of words. Training sees a bounded sample: at most
``max_positive`` and ``max_unlabelled`` distinct texts with the smallest hashes. Scoring touches each
text once where it is read; there is no shuffle of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from statloom.llm.text import ascii_words, byte_texts, small_batches


@dataclass
class ToxicityModel:
    words: list[bytes]
    weights: np.ndarray
    bias: float
    prior: float


def class_prior(labels: DataFrame, label_column: str = "toxic") -> float:
    """Share of label 1 among the labelled rows; 0 without any."""
    row = labels.agg(F.avg(F.when(F.col(label_column) == 1, 1.0).when(F.col(label_column) == 0, 0.0)).alias("p")).first()
    return float(row["p"] or 0.0)


def sample_ids(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int, id_column: str, label_column: str) -> DataFrame:
    """(id, positive) of the sampled training texts, bounded by the two numbers."""
    toxic = labels.where(F.col(label_column) == 1).select(id_column).where(F.col(id_column).isNotNull()).distinct()
    order = F.xxhash64(F.col(id_column), F.lit(29))
    ids = docs.select(id_column).where(F.col(id_column).isNotNull())
    first = toxic.join(ids.distinct(), id_column, "left_semi").orderBy(order, id_column).limit(positives)
    rest = ids.distinct().orderBy(order, id_column).limit(unlabelled)
    rows = [(r[0], 1) for r in first.collect()] + [(r[0], 0) for r in rest.collect()]
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.sparkSession.createDataFrame(rows, f"`{id_column}` {kind}, positive int")


def words_by_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, positive, words, mark): the distinct words of each text, and the least hash of its five-word runs.

    Copies and most near copies have the same mark; unrelated texts seldom do.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words, marks = [], []
            for data in byte_texts(batch, text_column):
                own = ascii_words(data)
                words.append(sorted({w.decode("utf-8", "replace") for w in own}))
                marks.append(min(zlib.crc32(b" ".join(own[i : i + 5])) for i in range(max(1, len(own) - 4))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string())), pa.array(marks, pa.int64())],
                names=[id_column, "positive", "words", "mark"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(id_column, "positive", text_column)
    return source.mapInArrow(cut, f"`{id_column}` {kind}, positive int, words array<string>, mark long")


def telling_words(words: DataFrame, limit: int, least_share: float = 0.02) -> list[str]:
    """Words in at least ``least_share`` of the positives and in more of them than chance explains, strongest first."""
    totals = words.agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u")).first()
    if not totals["p"] or not totals["u"]:
        return []
    counted = (
        words.select("positive", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
        .where(F.col("p") >= max(3.0, least_share * totals["p"]))
    )
    rate_p, rate_u = F.col("p") / totals["p"], F.col("u") / totals["u"]
    pooled = (F.col("p") + F.col("u") + 1) / (totals["p"] + totals["u"] + 2)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / totals["p"] + 1 / totals["u"]))
    score = (rate_p - rate_u) / spread
    rows = counted.select("word", score.alias("score")).where("score > 4").orderBy(F.desc("score"), "word").limit(limit)
    return [r["word"] for r in rows.collect()]


def fit(rows: list[tuple[int, list[int]]], size: int, prior: float, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias from (positive, feature numbers) rows by Adam on the non-negative risk.

    The loss is the sigmoid of the wrong side. It is bounded, so that the positives' part cannot drive
    the estimated risk of the clean texts below zero by sheer confidence.
    """
    owner = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    features = np.array([i for _, f in rows for i in f], np.int64)
    positive = np.array([p for p, _ in rows]) == 1
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    weights = np.zeros(size + 1)
    weights[size] = start = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights[features], len(rows)) + weights[size]
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = q * (1 - q)
        clean_risk = q[~positive].sum() / n_u - prior * q[positive].sum() / n_p
        gain = np.zeros(len(rows))  # slope of the risk by z
        if clean_risk >= 0:
            gain[positive] = -2 * prior * slope[positive] / n_p
            gain[~positive] = slope[~positive] / n_u
        else:
            gain[positive] = prior * slope[positive] / n_p
            gain[~positive] = -slope[~positive] / n_u
        g = np.append(np.bincount(features, gain[owner], size), gain.sum())
        g[:size] += 2e-5 * weights[:size]
        g[size] += 5e-3 * (weights[size] - start)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:size], float(weights[size])


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_positive: int = 4_000,
    max_unlabelled: int = 8_000,
    max_words: int = 256,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> ToxicityModel:
    """Fit on ``docs`` and ``labels``, both already reduced to training rows.

    Only label 1 marks a text; label 0 serves for the class prior alone. Copies of a text count once.
    Without positives the model has no words and scores the prior.
    """
    prior = class_prior(labels, label_column)
    ids = sample_ids(docs, labels, max_positive, max_unlabelled, id_column, label_column)
    sample = docs.select(id_column, text_column).join(F.broadcast(ids), id_column)
    words = words_by_text(sample, id_column, text_column).dropDuplicates(["mark", "positive"]).persist()
    try:
        chosen = telling_words(words, max_words)
        if not chosen:
            return ToxicityModel([], np.zeros(0), float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))), prior)
        kept = words.select("positive", F.filter("words", lambda w: w.isin(chosen)).alias("words"))
        number = {w: i for i, w in enumerate(chosen)}
        rows = [(r["positive"], sorted(number[w] for w in r["words"])) for r in kept.collect()]
    finally:
        words.unpersist()
    weights, bias = fit(sorted(rows), len(chosen), prior)
    return ToxicityModel([w.encode() for w in chosen], weights, bias, prior)


def score_texts(
    docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, score, predicted): the probability that label 1 fits, and whether it reaches ``threshold``.

    Null and empty texts score as texts without telling words; repeated rows, null ids and other
    columns do no harm.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = dict(zip(model.words, map(float, model.weights)))
        telling = weight.keys()
        for batch in small_batches(batches):
            z = [model.bias + sum([weight[w] for w in sorted(telling & set(ascii_words(t)))]) for t in byte_texts(batch, text_column)]
            scores = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                names=[id_column, "score", "predicted"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(score, f"`{id_column}` {kind}, score double, predicted int")
