import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from statloom.llm.crf_langid import (
    CrfModel,
    emissions,
    features_of,
    fit,
    forward_backward,
    label_texts,
    letters_of,
    mean_posteriors,
    train,
    word_scores,
)
from statloom.llm.queries import QUERIES
from statloom.llm.text import held_out, table


def test_posteriors_equal_enumeration():
    chance = np.random.default_rng(2)
    model = CrfModel(["a", "b", "c"], transitions=chance.normal(size=(3, 3)), start=chance.normal(size=3))
    scores = chance.normal(size=(5, 3))
    total = np.zeros((5, 3))
    for path in np.ndindex(*(3,) * 5):
        weight = np.exp(model.start[path[0]] + sum(scores[t, p] for t, p in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:])))
        for t, p in enumerate(path):
            total[t, p] += weight
    want = total / total.sum(1, keepdims=True)
    got, moves = forward_backward(model, scores[:, None, :])
    assert np.allclose(got[:, 0], want) and np.isclose(moves.sum(), 4)
    both = mean_posteriors(model, np.vstack([scores, scores[:2]]), np.array([5, 0, 2]))
    assert np.allclose(both[0], want.mean(0), atol=1e-5) and np.allclose(both[1], 0)


def test_held_out_accuracy_and_switches(spark):
    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    got = QUERIES["op10_language_id"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert row[0] > 0.97 and row[1] > 100
    model = train(docs.where(~held_out(F.col("doc_id"))))
    texts = {r.lang: r.text[:400] for r in docs.where("length(text) > 600").select("lang", "text").collect()}
    mixed = spark.createDataFrame([(0, texts["en"] + " " + texts["de"]), (1, texts["fr"])], "doc_id long, text string")
    first, second = label_texts(mixed, model).orderBy("doc_id").collect()
    shares = dict(zip(model.languages, first.shares))
    assert shares["en"] > 0.25 and shares["de"] > 0.25 and second.lang_pred == "fr"


def test_odd_rows(spark):
    rows = [(1, None, "en", 0.5), (2, "", "en", 0.5), (3, "123 -- !", None, 0.5), (None, "the words of this", "en", 0.5), (None, "the words of this", "en", 0.5), (4, "le mot ü " * 40_000, "fr", 0.5), (5, "日本語", None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = train(docs)
    got = sorted((tuple(r) for r in label_texts(docs, model).select("doc_id", "lang_pred", "score").collect()), key=repr)
    by_id = {r[0]: r for r in got}
    assert by_id[1] == (1, "und", 0.0) and by_id[2] == (2, "und", 0.0) and by_id[3] == (3, "und", 0.0)
    assert by_id[4][1] == "fr" and by_id[5][1] in ("en", "fr") and len(got) == 7
    assert [r.lang_pred for r in label_texts(docs, train(docs.where("lang = 'xx'"))).collect()] == ["und"] * 7
    assert label_texts(docs.limit(0), model).count() == 0 and fit([]).languages == []
    kept = label_texts(docs, model, keep=True)
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score", "shares"]


def test_features_are_not_held_for_all_texts_at_once(spark, monkeypatch):
    """Peak memory of labelling 2 MB of texts; the same scores as from features of all texts together."""
    model = fit([("en", "the cat sat on the mat a while"), ("fr", "le chat est sur la table à midi")] * 3, steps=2)
    texts = ["the cat sat à la table a " * 400, "", "a", " b ", "12 !"] * 190
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "__text"])
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, function, schema: function)
    label = label_texts(docs, model)
    tracemalloc.start()
    rows = [r for part in label(iter([batch])) for r in part.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90_000_000 and len(rows) == len(texts) and rows[1]["lang_pred"] == "und"
    buffers = [letters_of(t) for t in texts]
    f = features_of(b"  " + b"  ".join(buffers) + b"  ")
    scores, lengths = word_scores(model, buffers, most=5000)
    assert np.array_equal(scores, emissions(model, f)) and lengths.tolist() == [len(b.split()) for b in buffers]
