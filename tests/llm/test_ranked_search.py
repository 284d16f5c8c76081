"""Reversed search against a plain scorer of every (item, document) pair, and its defined cases."""

import math
import random
from collections import Counter

from pyspark.sql import types as T

from statloom.llm import ranked_search
from statloom.llm.text import ascii_words

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


def plain(docs, items, k=10):
    words = [(d, ascii_words((t or "").encode())) for d, t in docs]
    held = [(d, w) for d, w in words if w]
    n_docs, n_words = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out, by_item = [], {}
    for item, text in items:
        by_item.setdefault(item, set()).update(ascii_words((text or "").encode()))
    for item, terms in by_item.items():
        scores = []
        for d, w in held:
            if d is None:
                continue
            tf, m = Counter(w), 10 + (90 * len(w) * n_docs) // n_words
            s = 0
            for t in terms:
                if tf[t]:
                    weight = math.floor(1000.0 * math.log((2.0 * n_docs + 2.0) / (2.0 * df[t] + 1.0)))
                    s += weight * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if s > 0:
                scores.append((-s, d))
        for rank, (s, d) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, d, -s))
    return order(out)


def ranked(spark, docs, items, **kw):
    got = ranked_search.rank(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **kw)
    return order(tuple(r) for r in got.collect())


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Äpfel", "été", "x9"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))) for i in range(n)]
    items = [(j, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 6)))) for j in range(12)]
    return docs, items


def test_equals_plain_scores(spark):
    docs, items = corpus()
    assert ranked(spark, docs, items) == plain(docs, items)


def test_blocks_beyond_the_posting_bound_give_the_same_rows(spark):
    docs, items = corpus(seed=5)
    assert ranked(spark, docs, items, posting_bound=4) == plain(docs, items)


def test_ties_nulls_repeats_and_long_texts(spark):
    docs = [
        (1, "Apple pie"),
        (2, "apple PIE"),
        (3, None),
        (None, "apple apple"),
        (4, ""),
        (5, "apple pie"),
        (5, "apple pie"),
        (6, "pie " * 50_000 + "apple"),
        (7, "nothing here, 12 3"),
    ]
    items = [(10, "APPLE"), (10, "pie"), (11, "absent"), (None, "pie"), (12, None)]
    got = ranked(spark, docs, items)
    assert got == plain(docs, items)
    ids = [r[2] for r in got if r[0] == 10]
    assert ids[:2] == [1, 2]
    assert not [r for r in got if r[0] in (11, 12)]


def test_empty_tables_and_clashing_columns(spark):
    assert ranked(spark, [], [(1, "a")]) == []
    assert ranked(spark, [(1, "a b")], []) == []
    docs = spark.createDataFrame([(1, "red fox", 9, "x")], "doc_id long, text string, score long, term string")
    items = spark.createDataFrame([(1, "fox", "y")], "item_id long, text string, rank string")
    rows = [tuple(r) for r in ranked_search.rank(docs, items).collect()]
    assert rows == plain([(1, "red fox")], [(1, "fox")])
