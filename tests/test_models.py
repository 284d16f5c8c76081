import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import anomaly, cluster, dbscan, regression, series


def brute_dbscan(x, eps, least=5):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label = -np.ones(len(x), dtype=int)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            found = label.max() + 1
            stack = [i]
            label[i] = found
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & (label < 0)):
                    label[j] = found
                    if core[j]:
                        stack.append(j)
    return label, core


@pytest.mark.parametrize("eps", [None, 0.05])
def test_dbscan_matches_brute_force(spark, eps):
    rng = np.random.default_rng(1)
    # Copies of one point, one very dense region, two loose ones and noise.
    x = np.vstack([np.repeat([[1.0, 1.0]], 40, 0), rng.normal(0, 0.001, (80, 2)), rng.normal(3, 0.2, (60, 2)), rng.uniform(-2, 5, (40, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(len(x))))
    out = dbscan.dbscan(df, ["a", "b"], "id", eps)
    m = out["metrics"].first()
    z = (x - x.mean(0)) / x.std(0)
    if eps is None:
        gaps = np.sort(np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)), axis=1)[:, 4]
        assert m["eps"] == pytest.approx(np.percentile(gaps, 90))
    label, core = brute_dbscan(z, m["eps"])
    assert (m["n_clusters"], m["n_noise"], m["n_core"]) == (label.max() + 1, (label < 0).sum(), core.sum())
    got = {r["id"]: r["cluster"] for r in out["assignments"].collect()}
    assert len({(label[i], got[i]) for i in range(len(x)) if core[i]}) == label.max() + 1


def test_components_of_a_long_chain(spark):
    nodes = spark.range(30).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(19)] + [(25, 21), (21, 28)], "a long, b long")
    got = {r["node"]: r["component"] for r in dbscan.connected_components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(20)) and got[25] == got[21] == got[28] == 21 and got[29] == 29


def test_dbscan_needs_rows(spark):
    with pytest.raises(ValueError):
        dbscan.dbscan(spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 1.0)], "id int, a double, b double"), ["a", "b"], "id")


def test_isolation_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(400, 2)), [[9, 9], [-9, 8], [10, -9]]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(403)))
    scores = anomaly.isolation_scores(df, ["a", "b"], ["id"])
    assert {r["id"] for r in anomaly.isolation_top(scores, "id", 3).collect()} == {400, 401, 402}
    s = anomaly.isolation_summary(scores).first()
    assert s["total_rows"] == 403 and 3 <= s["anomaly_count"] < 120


def test_kmeans_and_ward_find_blobs(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.1, (50, 2)) for c in ((0, 0), (5, 5), (0, 5), (5, 0))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(200)))
    ward = cluster.hierarchical(df, ["a", "b"], ["id"], micro=40)["assignments"].toPandas().sort_values("id")
    assert sorted(pd.Series(ward["cluster"].to_numpy()).value_counts()) == [50, 50, 50, 50]
    fit = cluster.kmeans(df, ["a", "b"], ["id"], k=4)
    assert sorted(r["size"] for r in fit["sizes"].collect()) == [50, 50, 50, 50]
    assert fit["metrics"].first()["silhouette"] > 0.9


def test_elbow_rule():
    assert cluster.elbow_k([100.0, 40.0, 38.0, 37.0], 5) == 2
    assert cluster.elbow_k([5.0, 4.0], 3) == 3


def test_pca_ratios(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": a + rng.normal(size=300) * 0.1, "c": rng.normal(size=300)}))
    ratios = [r["ratio"] for r in cluster.pca(df, ["a", "b", "c"])["variance"].orderBy("component").collect()]
    assert sum(ratios) == pytest.approx(1) and ratios[0] > 0.6


def test_linear_recovers_coefficients(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"id": range(400), "a": rng.normal(size=400), "b": rng.normal(size=400)})
    pdf["y"] = 3 + 2 * pdf["a"] - pdf["b"] + rng.normal(size=400) * 0.01
    fit = regression.linear_fit(spark.createDataFrame(pdf), "y", ["a", "b"], "id")
    got = {r["name"]: r["coefficient"] for r in fit["coefficients"].collect()}
    assert got == pytest.approx({"a": 2, "b": -1, "(intercept)": 3}, abs=0.01)
    assert fit["metrics"].first()["r2"] > 0.99


def test_polynomial_prefers_cubic(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-3, 3, 400)
    pdf = pd.DataFrame({"id": range(400), "x": x + 100, "y": x**3 - x + rng.normal(size=400) * 0.2})
    fit = regression.polynomial_fit(spark.createDataFrame(pdf), "y", "x", "id")
    r2 = {r["degree"]: r["r2"] for r in fit["metrics"].collect()}
    assert r2[3] > 0.99 > r2[2]


def test_logistic_separates(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=500)
    pdf = pd.DataFrame({"id": range(500), "x": x, "y": (x + rng.normal(size=500) * 0.3 > 0).astype(int)})
    m = regression.logistic_fit(spark.createDataFrame(pdf), "y", ["x"], "id")["metrics"].first()
    assert m["auc"] > 0.9 and m["accuracy"] > 0.8


def test_vif_of_collinear_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 3), 1.0 + i % 2) for i in range(30)], "a double, b double, c double")
    got = {r["column"]: r["vif"] for r in regression.vif(df, ["a", "b", "c"]).collect()}
    assert got["a"] > 10 and got["c"] < 10


def _series(spark, values):
    days = pd.date_range("2023-01-01", periods=len(values))
    return spark.createDataFrame(pd.DataFrame({"ds": days, "y": values})).withColumn("ds", F.col("ds").cast("timestamp_ntz"))


def test_arima_on_an_autoregression(spark):
    rng = np.random.default_rng(10)
    y = [0.0]
    for e in rng.normal(size=299):
        y.append(0.8 * y[-1] + e)
    best = series.arima(_series(spark, y)).first()
    assert best["d"] == 0 and best["p"] >= 1 and best["rmse"] == pytest.approx(1, abs=0.15)
    assert len(best["forecast"]) == 30
    widths = [f["yhat_upper"] - f["yhat_lower"] for f in best["forecast"]]
    assert all(b >= a - 1e-9 for a, b in zip(widths, widths[1:]))


def test_stationarity_separates_walk_from_noise(spark):
    rng = np.random.default_rng(11)
    noise = rng.normal(size=300)
    assert series.adf(_series(spark, noise)).first()["p_value"] < 0.01
    assert series.adf(_series(spark, np.cumsum(noise))).first()["p_value"] > 0.05


def test_granger_direction(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=301)
    y = np.r_[0, 0.9 * x[:-1]] + rng.normal(size=301) * 0.3
    df = spark.createDataFrame(pd.DataFrame({"ds": pd.date_range("2023-01-01", periods=301), "x": x, "y": y}))
    assert series.granger(df, "ds", "y", "x").where("lag = 1").first()["p_value"] < 1e-6
    assert series.granger(df, "ds", "x", "y").where("lag = 1").first()["p_value"] > 1e-3


def test_additive_forecast_follows_trend_and_week(spark):
    t = np.arange(200)
    f = series.additive_forecast(_series(spark, 10 + 0.5 * t + 5 * np.sin(2 * np.pi * t / 7)))
    ahead = f.where("is_future").toPandas()
    want = 10 + 0.5 * np.arange(200, 290)
    assert len(ahead) == 90 and np.abs(ahead["trend"] - want).max() < 12
    assert series.forecast_summary(f).first()["trend_direction"] == "up"
    assert (ahead["yhat_upper"] > ahead["yhat_lower"]).all()


def _plain_hannan_rissanen(y, d, p, q, m=series.LONG_AR, pmax=2, qmax=2):
    """Both stages by numpy least squares on the sample the operator uses."""
    w = np.diff(y, d) if d else np.asarray(y, dtype=float)
    n = len(w)
    lags = np.column_stack([np.ones(n - m)] + [w[m - i : n - i] for i in range(1, m + 1)])
    a = np.linalg.lstsq(lags, w[m:], rcond=None)[0]
    e = np.full(n, np.nan)
    e[m:] = w[m:] - lags @ a
    start = max(pmax, m + qmax)
    cols = ([np.ones(n - start)] if d == 0 else []) + [w[start - i : n - i] for i in range(1, p + 1)]
    cols += [e[start - j : n - j] for j in range(1, q + 1)]
    target = w[start:]
    if cols:
        x = np.column_stack(cols)
        beta = np.linalg.lstsq(x, target, rcond=None)[0]
        rss = float(((target - x @ beta) ** 2).sum())
    else:
        rss = float((target**2).sum())
    k, size = len(cols), len(target)
    return size * (np.log(2 * np.pi * rss / size) + 1) + 2 * (k + 1)


def test_arima_orders_equal_plain_hannan_rissanen(spark):
    rng = np.random.default_rng(21)
    shocks = rng.normal(size=400)
    y = [5.0]
    for t in range(1, 400):
        y.append(1.0 + 0.6 * y[-1] + shocks[t] + 0.4 * shocks[t - 1])
    fits = series.arima_fits(_series(spark, y), []).collect()
    assert len(fits) >= 12
    for row in fits:
        want = _plain_hannan_rissanen(np.array(y), row["d"], row["p"], row["q"])
        assert row["aic"] == pytest.approx(want, rel=1e-9), (row["p"], row["d"], row["q"])
    best = min(fits, key=lambda r: (r["aic"], r["p"], r["d"], r["q"]))
    assert best["d"] == 0 and best["p"] >= 1 and best["q"] >= 1


def test_arima_per_series_keys_and_short_series(spark):
    rng = np.random.default_rng(22)
    a = np.cumsum(rng.normal(size=200))
    frame = pd.DataFrame(
        {"k": ["a"] * 200 + ["b"] * 6, "ds": list(pd.date_range("2023-01-01", periods=200)) + list(pd.date_range("2023-01-01", periods=6)), "y": list(a) + [1.0] * 6}
    )
    df = spark.createDataFrame(frame).withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    got = {r["k"]: r for r in series.arima(df, ["k"]).collect()}
    assert set(got) == {"a"}
    assert got["a"]["forecast"][0]["ds"] == pd.Timestamp("2023-07-20").to_pydatetime()


def test_barnes_hut_forces_within_five_percent_of_all_pairs(spark):
    from statloom.operators import layout

    rng = np.random.default_rng(31)
    pts = np.r_[rng.normal(size=(250, 2)), rng.normal(size=(150, 2)) * 0.2 + 5, [[9.0, 9.0]] * 3]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    got = {r["id"]: r for r in layout.repulsion(df).collect()}
    d = pts[:, None, :] - pts[None, :, :]
    q = 1 / (1 + (d**2).sum(-1))
    np.fill_diagonal(q, 0)
    z, r = q.sum(1), (q[:, :, None] ** 2 * d).sum(1)
    gz = np.array([got[i]["z"] for i in range(len(pts))])
    gr = np.array([[got[i]["rx"], got[i]["ry"]] for i in range(len(pts))])
    assert np.all(np.abs(gz - z) <= 0.05 * z)
    assert np.all(np.linalg.norm(gr - r, axis=1) <= 0.05 * np.linalg.norm(r, axis=1) + 1e-9)


def test_tsne_keeps_more_neighbours_than_its_pca_start(spark):
    from pyspark.ml.functions import array_to_vector

    from statloom.operators import cluster, layout

    rng = np.random.default_rng(32)
    pts = np.concatenate([c + rng.normal(size=(30, 10)) for c in rng.normal(size=(5, 10)) * 3])
    cols = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], ["key", *cols])

    def overlap(xy, k=10):
        near = np.argsort(((pts[:, None] - pts[None]) ** 2).sum(-1), 1)[:, 1 : k + 1]
        flat = np.argsort(((xy[:, None] - xy[None]) ** 2).sum(-1), 1)[:, 1 : k + 1]
        return np.mean([len(set(a) & set(b)) / k for a, b in zip(near, flat)])

    laid = sorted(layout.tsne_layout(df, cols, "key").collect(), key=lambda r: r["key"])
    rows = cluster.standardised(df, cols, ["key"]).withColumn("features", array_to_vector("xs"))
    start = sorted(cluster.projection(rows, ["key"]).collect(), key=lambda r: r["key"])
    assert overlap(np.array([[r["x"], r["y"]] for r in laid])) > overlap(np.array([[r["pc1"], r["pc2"]] for r in start]))


@pytest.mark.parametrize("partitions", ["3", "17"])
def test_neighbour_descent_recall_against_brute_force(spark, partitions):
    from statloom.operators import layout

    rng = np.random.default_rng(33)
    pts = np.concatenate([c + rng.normal(size=(100, 12)) for c in rng.normal(size=(4, 12)) * 2])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, xs array<double>")
    k = 10
    truth = np.argsort(((pts[:, None] - pts[None]) ** 2).sum(-1), 1)[:, 1 : k + 1]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {}
        for r in layout.neighbor_graph(df, 12, k).collect():
            got.setdefault(r["id"], set()).add(r["other"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    recall = np.mean([len(got.get(i, set()) & set(t)) / k for i, t in enumerate(truth)])
    assert recall >= 0.9, recall
    assert all(len(v) == k for v in got.values()) and len(got) == len(pts)


def test_laplace_bends_meet_their_optimality_conditions():
    rng = np.random.default_rng(3)
    n, p = 400, 12
    x = np.c_[np.ones(n), rng.normal(size=(n, p - 1)) * 0.05]
    y = x @ np.r_[1.0, 0.0, 0.0, 2.0, 0, 0, 0, 0, 0, 0.5, 0, 0] + rng.normal(size=n) * 0.5
    z = np.c_[x, y, np.ones(n)]
    bends = list(range(1, 9))
    beta, _ = series.laplace_bends(z.T @ z, bends)
    free = np.linalg.lstsq(x, y, rcond=None)[0]
    sigma2 = float(((y - x @ free) ** 2).sum()) / n
    ridge = np.ones(p)
    ridge[[0, *bends]] = 0.0
    grad = (x.T @ (x @ beta - y)) / sigma2 + ridge * beta
    for j in bends:
        assert (abs(grad[j] + np.sign(beta[j])) if beta[j] != 0 else abs(grad[j]) - 1) < 1e-6
    assert np.allclose(grad[[0, 9, 10, 11]], 0, atol=1e-6)
    assert (beta[bends] == 0).sum() >= 2


def test_additive_forecast_finds_a_planted_bend(spark, monkeypatch):
    rng = np.random.default_rng(7)
    days = np.arange(400)
    y = 10 + 0.05 * days + np.where(days > 196, 0.15 * (days - 196), 0) + rng.normal(size=400) * 0.5
    seen = {}
    fit = series.laplace_bends

    def spy(gram, bends, rounds=20000):
        beta, rmse = fit(gram, bends, rounds)
        seen["bends"] = beta[bends]
        return beta, rmse

    monkeypatch.setattr(series, "laplace_bends", spy)
    out = series.additive_forecast(_series(spark, list(y))).where("not is_future").toPandas()
    assert int(np.argmax(np.abs(seen["bends"]))) == 15
    assert float(np.sqrt(((out.y - out.yhat) ** 2).mean())) < 0.6


def test_descent_meets_every_candidate_within_the_limit(spark):
    import numpy as np

    from statloom.operators import layout

    d, k = 3, 4
    xs = np.random.default_rng(3).normal(size=(90, d))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "id long, xs array<double>")
    start = {i: [(i + s) % 90 for s in (1, 2, 3, 30)] for i in range(90)}
    gap = lambda a, b: float(np.sqrt(((xs[a] - xs[b]) ** 2).sum()))
    graph = spark.createDataFrame([(i, o, gap(i, o)) for i, near in start.items() for o in near], "id long, other long, dist double")
    back = {o: sorted((gap(i, o), i) for i, near in start.items() if o in near)[:k] for o in range(90)}
    near = {i: {*start[i], *(a for _, a in back[i])} for i in range(90)}
    want = {}
    for i in range(90):
        seen = ({c for b in near[i] for c in near[b]} | {*start[i]}) - {i}
        want[i] = {o for _, o in sorted((gap(i, o), o) for o in seen)[:k]}
    got = {}
    for r in layout.neighbor_descent(df, graph, d, k, 1).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert got == want
    # a row meets a whole list in one step: no row per candidate holds a vector
    met = spark.createDataFrame(
        [([(1, None, [0.0]), (2, 1.5, [1.0])], [(2, [1.0]), (3, [3.0])])],
        "asking array<struct<id:long,limit:double,xs:array<double>>>, near array<struct<other:long,ys:array<double>>>",
    )
    assert sorted(map(tuple, layout.measured(met, 1).collect())) == [(1, 2, 1.0), (1, 3, 3.0)]


def test_heavy_columns_are_ranked_without_a_shuffle_of_the_rows(spark):
    from statloom.operators import correlation

    df = spark.range(4000).selectExpr("cast(id % 7 AS double) AS a", "cast(id * id % 11 AS double) AS b")
    got = correlation.spearman_pairs(df, ["a", "b"])
    assert str(got._jdf.queryExecution().optimizedPlan()).count("Join ") == 2
    want = df.toPandas().rank().corr().loc["a", "b"]
    assert abs(got.first()["spearman"] - want) < 1e-12


def test_quality_sheet_computes_its_checks_once(spark):
    from statloom.plans import results

    checks = spark.range(4).selectExpr("concat('m', id % 2) AS analysis_id", "id <> 3 AS passed", "concat('note ', id) AS message")
    sheet = results.quality_sheet(checks)
    assert "Range" not in str(sheet._jdf.queryExecution().optimizedPlan())
    assert sorted(map(tuple, sheet.collect())) == [
        ("(overall)", "1 warnings", ""), ("m0", "passed", "all assumptions met"), ("m1", "warning", "- note 3"),
    ]


def test_tasks_that_hold_the_quad_tree_open_the_same_cells_as_joins(spark, monkeypatch):
    from statloom.operators import layout

    rng = np.random.default_rng(41)
    pts = np.r_[rng.normal(size=(300, 2)), rng.normal(size=(200, 2)) * 0.01 + 3, [[9.0, -9.0]] * 4]
    df = spark.createDataFrame([(3 * i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    near = layout.repulsion(df)
    assert "Join" not in str(near._jdf.queryExecution().optimizedPlan())  # no join a level
    monkeypatch.setattr(layout, "CELL_BROADCAST", 20)
    far = layout.repulsion(df)
    got, want = (np.array(sorted(map(tuple, t.collect()))) for t in (near, far))
    assert (got[:, 0] == want[:, 0]).all() and len(got) == len(pts)
    assert np.allclose(got, want, rtol=1e-11, atol=1e-11)


def test_layout_is_the_same_when_no_task_can_hold_the_points(spark, monkeypatch):
    from statloom.operators import layout

    rng = np.random.default_rng(42)
    pts = np.concatenate([c + rng.normal(size=(20, 3)) for c in (0, 4)])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "key long, a double, b double, c double")
    lay = lambda: np.array(sorted(map(tuple, layout.tsne_layout(df, list("abc"), "key", epochs=2, k=6).collect())))
    near = lay()
    monkeypatch.setattr(layout, "CELL_BROADCAST", 20)
    assert np.allclose(near, lay(), rtol=1e-9, atol=1e-12)


def test_followers_cross_batches_but_not_ranges(spark):
    from statloom.operators import layout

    xs = np.random.default_rng(43).normal(size=(120, 3))
    rows = [(i % 2, i // 60, 1000 - i, xs[i].tolist(), float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "t int, _range int, id long, xs array<double>, s double").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, layout.followers(df.sortWithinPartitions("t", "_range", "s"), 3).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = []
    for t in (0, 1):
        for r in (0, 1):
            line = [i for i in range(120) if i % 2 == t and i // 60 == r]
            for place, i in enumerate(line):
                want += [(1000 - i, 1000 - j, float(np.sqrt(((xs[i] - xs[j]) ** 2).sum()))) for j in line[place + 1 : place + 1 + layout.WINDOW]]
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], rtol=1e-12)
