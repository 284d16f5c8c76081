import math
import random

import numpy as np

from statloom.llm.topk import Search, packed, top_k, unpack


def brute(queries, rows, k):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(1024 * x) for x in v]

    out = set()
    for q, v in {(a, tuple(b)) for a, b in queries if a is not None and b is not None}:
        a = whole(v)
        if a is None:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b)), i) for i, w in rows if i is not None and i != q for b in [whole(w)] if b is not None]
        out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k]))
    return sorted(out)


def test_equals_brute_force(spark):
    chance = random.Random(6)
    rows = [(i, [float(np.float32(chance.gauss(0, 0.2))) for _ in range(8)]) for i in range(700)]
    rows += [(i, rows[5][1]) for i in range(700, 760)]  # copies: ties across blocks
    rows += [(900, None), (901, [0.1, None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [0.1] * 8), (904, []), (905, [1.0, 2.0])]
    frame = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    queries = [r for r in rows if r[0] is not None and r[0] % 100 == 0]
    got = top_k(frame.where("vec_id % 100 = 0"), frame, block=16, blocks_per_row=4, queries_per_row=3, searches_at_once=2)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(queries, rows, 10)


def test_few_candidates_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(frame.where("vec_id = 0"), frame).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert top_k(frame.limit(0), frame).count() == 0 and top_k(frame, frame.where("vec_id = 7")).count() == 0


def test_blocks_below_the_bound_are_skipped():
    vectors = np.vstack([np.full((64, 4), 100), np.full((960, 4), -100)]).astype(np.int64)
    search = Search(np.zeros(1, np.int64), np.array([-1]), np.full((1, 4), 10, np.int64), 10)
    search.visit(np.arange(1024), vectors, 64)
    assert search.scored == 64 and list(search.found[0]) == list(range(10))


def test_copies_for_the_shards_are_not_broadcast(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"  # small tables would be broadcast
    frame = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = top_k(frame.where("vec_id % 100 = 0"), frame)
    assert len(got.collect()) == 30
    plan = str(got._jdf.queryExecution().executedPlan())
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_hold_values_of_any_width():
    for most in (3, 2**15 - 1, 2**15, 2**31 - 1, 2**31, 2**62 - 1):
        matrix = np.array([[0, most], [-most - 1, 5]], np.int64)
        data = packed(matrix)
        assert len(data) == 4 * (2 if most < 2**15 else 4 if most < 2**31 else 8)
        keys, ids, back = unpack(2, 2, np.array([7, 1, 8, 2], np.int64).tobytes(), data)
        assert back.dtype == np.int64 and (back == matrix).all() and list(keys) == [7, 8] and list(ids) == [1, 2]
    assert unpack(1, 0, np.array([7, 1], np.int64).tobytes(), packed(np.zeros((1, 0), np.int64)))[2].shape == (1, 0)
