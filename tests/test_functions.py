import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.functions.ordered import lagged, positions, prefix_sum, weighted_quantiles
from statloom.functions.special import beta_inc, chi2_upper, f_upper, log_gamma, normal_two_sided, t_quantile


@pytest.mark.parametrize("partitions", ["8", "100"])
def test_prefix_sum_matches_pandas(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rng = np.random.default_rng(3)
    # A third of the rows share the smallest order value's neighbourhood, and one key is hot.
    pdf = pd.DataFrame({"k": rng.choice(["hot", "a", "b"], 900, p=[0.8, 0.1, 0.1]), "v": rng.permutation(900) ** 2 % 977 * 1.0})
    pdf = pdf.drop_duplicates().assign(n=rng.integers(1, 9, len(pdf.drop_duplicates())))
    df = spark.createDataFrame(pdf).repartition(5)
    got = prefix_sum(df, ["v"], {"run": "n"}, ["k"], {"all": "n"})
    got = got.toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "v"]).reset_index(drop=True)
    want["run"] = want.groupby("k")["n"].cumsum()
    want["all"] = want.groupby("k")["n"].transform("sum")
    pd.testing.assert_frame_equal(got[["k", "v", "run", "all"]], want[["k", "v", "run", "all"]], check_dtype=False)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_descending_order_with_ties_on_value(spark):
    df = spark.createDataFrame([("c", 5.0), ("a", 5.0), ("b", 5.0), ("d", 9.0)], "label string, value double")
    rows = prefix_sum(df, ["value", "label"], {"run": "value"}, descending_first=True).orderBy("run").collect()
    assert [(r["label"], r["run"]) for r in rows] == [("d", 9.0), ("a", 14.0), ("b", 19.0), ("c", 24.0)]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.lognormal(size=500), 1)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).groupBy("v").agg(F.count("*").alias("n"))
    r = weighted_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(values, [0.1, 0.5, 0.9]))
    assert r["_n"] == 500


def test_lags_and_positions(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(20)], "t int, v double").repartition(4)
    rows = lagged(df, ["t"], ["v"], 2).orderBy("t").collect()
    assert [(r["v_l0"], r["v_l1"], r["v_l2"]) for r in rows[:3]] == [(0.0, None, None), (1.0, 0.0, None), (4.0, 1.0, 0.0)]
    assert [r["_pos"] for r in positions(df, ["t"]).orderBy("t").collect()] == list(range(1, 21))


def test_empty_input(spark):
    df = spark.createDataFrame([], "v double, n long")
    assert prefix_sum(df, ["v"], {"run": "n"}).count() == 0


def test_known_p_values(spark):
    # (f, d1, d2, upper tail)
    cases = [
        (3.0, 2.0, 6.0, 0.125),
        (0.982, 4.0, 1495.0, 0.416186169),
        (2.5, 4.0, 60000.0, 0.0404389121),
        (1.02, 40000.0, 20000.0, 0.0532947191),
        (1.5, 1.0, 4.0, 0.287864135),
        (3.84, 1.0, 1e6, 0.0500437986),
        (3.84, 1.0, 1e12, 0.0500435212),
    ]
    df = spark.createDataFrame(cases, "f double, d1 double, d2 double, p double")
    for r in df.select("p", f_upper(F.col("f"), F.col("d1"), F.col("d2")).alias("q")).collect():
        assert r["q"] == pytest.approx(r["p"], abs=6e-10)


def test_other_distributions(spark):
    r = spark.range(1).select(
        beta_inc(F.lit(0.3), F.lit(0.7), F.lit(2.0), F.lit(5.0)).alias("b"),
        log_gamma(F.lit(0.5)).alias("g"),
        chi2_upper(F.lit(15.5), F.lit(8)).alias("c"),
        normal_two_sided(F.lit(1.959963984540054)).alias("z"),
        t_quantile(0.05, F.lit(4.0)).alias("t"),
    ).first()
    assert r["b"] == pytest.approx(0.579825, abs=1e-6)
    assert r["g"] == pytest.approx(np.log(np.pi) / 2, abs=1e-10)
    closed = np.exp(-7.75) * sum(7.75**k / np.prod(range(1, k + 1)) for k in range(4))
    assert r["c"] == pytest.approx(closed, abs=1e-10)
    assert r["z"] == pytest.approx(0.05, abs=1e-10)
    assert r["t"] == pytest.approx(2.776445105, abs=1e-8)


def test_studentized_range_against_published_tables(spark):
    from statloom.functions.special import studentized_range_upper, t_two_sided

    # (q, k, df, upper tail) at the tabulated 5 % and 1 % points, three decimals.
    points = [
        (3.877, 3, 10, 0.05), (4.327, 4, 10, 0.05), (4.654, 5, 10, 0.05), (5.599, 10, 10, 0.05), (3.578, 3, 20, 0.05),
        (3.958, 4, 20, 0.05), (4.232, 5, 20, 0.05), (4.602, 3, 5, 0.05), (5.673, 5, 5, 0.05), (3.399, 3, 60, 0.05),
        (5.270, 3, 10, 0.01), (6.085, 2, 2, 0.05), (3.314, 3, 100000, 0.05),
    ]
    df = spark.createDataFrame(points, "q double, k int, df int, want double")
    got = df.select("*", studentized_range_upper(F.col("q"), F.col("k"), F.col("df")).alias("p"),
                    t_two_sided(F.col("q") / 2**0.5, F.col("df")).alias("t")).collect()
    for r in got:
        assert abs(r["p"] - r["want"]) < 1e-4, (r["q"], r["k"], r["df"], r["p"])
        if r["k"] == 2:
            assert abs(r["p"] - r["t"]) < 1e-6


def test_tukey_pairs_of_planted_means(spark):
    from statloom.operators import hypothesis

    rows = [(g, float(m + (i % 7) - 3)) for g, m in (("a", 0.0), ("b", 0.2), ("c", 6.0)) for i in range(40)]
    got = {(r["group1"], r["group2"]): r for r in hypothesis.tukey_hsd(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert not got[("a", "b")]["significant"] and got[("a", "c")]["significant"] and got[("b", "c")]["significant"]
    assert got[("a", "b")]["dof"] == 117


def test_bracketed_quantiles_equal_numpy_with_a_hot_value(spark):
    from statloom.operators.counts import column_quantiles

    rng = np.random.default_rng(41)
    a = np.r_[rng.normal(size=4000), np.full(2000, 0.25), [1e12, -1e12]]
    b = np.r_[rng.integers(0, 5, size=3000).astype(float), [np.nan] * 5]
    rows = [(float(x), float(b[i]) if i < len(b) else None) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p999": 0.999, "p100": 1.0}
    got = {r["column"]: r for r in column_quantiles(df, ["a", "b"], probs).collect()}
    present = {"a": a, "b": b[~np.isnan(b)]}
    for name, values in present.items():
        assert got[name]["_n"] == len(values)
        for q, p in probs.items():
            assert got[name][q] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12), (name, q)


def test_spearman_with_a_value_in_half_the_rows(spark):
    from statloom.operators import correlation

    rng = np.random.default_rng(42)
    x = np.r_[np.full(3000, 2.0), rng.normal(size=3000)]
    y = x * 0.5 + rng.normal(size=6000)
    z = rng.integers(0, 3, size=6000).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, z)], "x double, y double, z double")
    got = {(r["col1"], r["col2"]): r["spearman"] for r in correlation.spearman_pairs(df, ["x", "y", "z"]).collect()}
    ranks = pd.DataFrame({"x": x, "y": y, "z": z}).rank()
    want = ranks.corr()
    for (a, b), rho in got.items():
        assert rho == pytest.approx(want.loc[a, b], abs=1e-9)
    plan = correlation._shared_ranks(df, ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
