import numpy as np
from pyspark.sql import functions as F

from statloom.llm.pu_toxicity import fit, score_texts, train
from statloom.llm.queries import QUERIES
from statloom.llm.text import table


def test_learns_from_positives_and_unlabelled():
    chance = np.random.default_rng(3)
    toxic, clean = lambda: [0] + [int(i) for i in chance.integers(1, 8, 2)], lambda: [int(i) for i in chance.integers(1, 8, 2)]
    rows = [(1, sorted(set(toxic()))) for _ in range(60)]
    rows += [(0, sorted(set(toxic() if chance.random() < 0.2 else clean()))) for _ in range(400)]
    weights, bias = fit(rows, 8, 0.2)
    score = lambda features: 1 / (1 + np.exp(-(weights[features].sum() + bias)))
    assert score([0, 2]) > 0.7 and score([2, 3]) < 0.3


def test_held_out_texts(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op3_toxicity"](spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out").toPandas()
    ranks = got.score.rank()
    toxic = got.toxic == 1
    area = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area > 0.85
    assert got[got.predicted == 1].toxic.mean() > 0.85 and got[toxic].predicted.mean() > 0.7


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, ("vile " if i % 4 == 0 else "") + f"word{i} some text", "x") for i in range(60)] + [(None, None, "x"), (70, "", "x"), (7, "vile again", "x"), (71, "vile " * 50_000, "x")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(None, 1), (999, 1), (0, 1)], "doc_id long, toxic int")
    model = train(docs, labels)
    got = score_texts(docs, model)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == 64
    assert got.where("doc_id = 71").first().predicted == 1
    empty = got.where("doc_id is null or doc_id = 70").select("score").distinct().collect()
    assert len(empty) == 1 and empty[0].score < 0.3
    nothing = train(docs, labels.where("toxic = 5"))
    assert score_texts(docs, nothing).select("score").distinct().count() == 1
    assert score_texts(docs.limit(0), model).count() == 0 and train(docs.limit(0), labels).words == []
