"""Hand-worked inputs with expected values."""

from datetime import datetime
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import anomaly, basket, business, clean, correlation, hypothesis, profile, regression, relational, series, survival
from statloom.plans.guardrails import PIECE, check_assumptions, normality, rank_pieces


def groups(spark, *parts):
    rows = [(name, float(v)) for name, values in parts for v in values]
    return spark.createDataFrame(rows, "g string, v double")


def test_cohort(spark):
    rows = [(datetime(2023, 1, 1), "u1"), (datetime(2023, 1, 2), "u2"), (datetime(2023, 2, 1), "u1"), (datetime(2023, 2, 2), "u3")]
    df = spark.createDataFrame(rows, "date timestamp_ntz, user_id string")
    got = {(r["cohort"], r["period"]): (r["cohort_size"], r["retention_pct"]) for r in business.cohort(df, "user_id", "date").collect()}
    assert got == {("2023-01", 0): (2, 100.0), ("2023-01", 1): (2, 50.0), ("2023-02", 0): (1, 100.0), ("2023-02", 1): (1, 0.0)}


def test_clean(spark):
    df = spark.createDataFrame([(1, 10, "A"), (2, None, "B"), (3, 30, "A"), (3, 30, "A")], "id int, val int, cat string")
    issues = {(r["column"], r["issue_type"]): (r["severity"], r["count"]) for r in clean.detect_issues(df).collect()}
    assert issues == {("(all)", "duplicates"): ("high", 1), ("val", "missing_values"): ("medium", 1)}
    fixed, log = clean.apply_all_fixes(df)
    assert sorted((r["id"], r["val"]) for r in fixed.collect()) == [(1, 10), (2, 20), (3, 30)]
    assert {r["outcome"] for r in log.collect()} == {"applied"}


def test_detect_only_missing(spark):
    rows = [(1.0, 1, "x"), (2.0, 1, "x"), (float("nan"), 1, "y"), (4.0, 1, "y")]
    got = clean.detect_issues(spark.createDataFrame(rows, "a double, b long, c string")).collect()
    assert [(r["column"], r["issue_type"], r["count"], r["severity"]) for r in got] == [("a", "missing_values", 1, "medium")]
    one = spark.createDataFrame([(1.0,), (None,), (3.0,)], "a double")
    assert sorted(r["a"] for r in clean.fill_missing(one, ["a"]).collect()) == [1.0, 2.0, 3.0]


def test_pareto(spark):
    df = spark.createDataFrame([("A", 50.0), ("B", 25.0), ("C", 15.0), ("D", 10.0)], "k string, v double")
    table = business.pareto(df, "k", "v")
    assert [(r["label"], r["cumulative_pct"], r["in_80"]) for r in table.orderBy("cumulative_pct").collect()] == [
        ("A", 50.0, True), ("B", 75.0, True), ("C", 90.0, True), ("D", 100.0, False)]
    assert business.pareto_summary(table).first()["items_80_pct"] == 3


def test_pareto_exact_eighty(spark):
    df = spark.createDataFrame([("A", 80.0), ("B", 20.0)], "k string, v double")
    assert [r["label"] for r in business.pareto(df, "k", "v").where("in_80").collect()] == ["A"]


def test_kaplan_meier(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 1), (4, 0)], "t int, e int")
    curve = survival.kaplan_meier(df, "t", "e")
    rows = curve.orderBy("time").collect()
    assert [r["at_risk"] for r in rows] == [5, 4, 2, 1]
    assert np.allclose([r["survival"] for r in rows], [0.8, 0.6, 0.3, 0.3])
    assert tuple(survival.survival_summary(curve).first()) == (3.0, 3, 5)


def test_survival_not_reached_is_null(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0), (5, 0)], "t int, e int")
    assert survival.survival_summary(survival.kaplan_meier(df, "t", "e")).first()["median_survival"] is None


def test_mann_whitney_exact(spark):
    r = hypothesis.mann_whitney(groups(spark, ("g1", [1, 2, 3]), ("g2", [4, 5, 6])), "v", "g").first()
    assert (r["u_stat"], r["rank_biserial"], r["median1"], r["median2"]) == (0.0, 1.0, 2.0, 5.0)
    assert r["p_value"] == pytest.approx(0.1)


def test_chi_square_yates(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 20 + [("b", "y")] * 10
    r = hypothesis.chi_square(spark.createDataFrame(rows, "p string, q string"), "p", "q").first()
    assert r["chi2"] == pytest.approx(5.4) and r["dof"] == 1 and r["cramers_v"] == pytest.approx(0.3)


def test_chi_square_counts_empty_cells(spark):
    rows = [("a", "x")] * 5 + [("b", "y")] * 5 + [("c", "x")] * 4 + [("c", "y")] * 6
    r = hypothesis.chi_square(spark.createDataFrame(rows, "p string, q string"), "p", "q").first()
    observed = np.array([[5, 0], [0, 5], [4, 6]], dtype=float)
    expected = observed.sum(1, keepdims=True) * observed.sum(0) / 20
    assert r["chi2"] == pytest.approx(((observed - expected) ** 2 / expected).sum())


def test_ttest(spark):
    r = hypothesis.ttest(groups(spark, ("a", [1, 2, 3]), ("b", [2, 3, 4])), "v", "g").first()
    assert r["t_stat"] == pytest.approx(-1.224745, abs=1e-6) and r["dof"] == 4 and r["cohens_d"] == pytest.approx(-1)


def test_anova(spark):
    r = hypothesis.anova(groups(spark, ("a", [1, 2, 3]), ("b", [2, 3, 4]), ("c", [3, 4, 5])), "v", "g").first()
    assert r["f_stat"] == pytest.approx(3) and r["eta_squared"] == pytest.approx(0.5) and r["p_value"] == pytest.approx(0.125)


def test_basket(spark):
    rows = [("t1", "a"), ("t1", "b"), ("t2", "a"), ("t2", "b"), ("t3", "a"), ("t4", "c"), ("t1", "a")]
    df = spark.createDataFrame(rows, "tid string, item string")
    rules = basket.association_rules(basket.frequent_itemsets(df, "tid", "item")).collect()
    got = {(r["antecedent"][0], r["consequent"][0]): (r["support"], round(r["confidence"], 4), round(r["lift"], 4)) for r in rules}
    assert got == {("a", "b"): (0.5, 0.6667, 1.3333), ("b", "a"): (0.5, 1.0, 1.3333)}


def test_multi_item_consequents(spark):
    df = spark.createDataFrame([(t, i) for t in range(4) for i in "abc"] + [(9, "d")], "tid int, item string")
    rules = basket.association_rules(basket.frequent_itemsets(df, "tid", "item")).collect()
    assert ("a", "b,c") in {(",".join(r["antecedent"]), ",".join(r["consequent"])) for r in rules}
    assert len(rules) == 12


def test_gaps_raise_a_flag(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 3, 4, 30)], "day timestamp_ntz")
    assert tuple(series.date_gaps(df, "day").first()) == (5, 1.0, 26.0)
    checks = {r["test"]: r["passed"] for r in check_assumptions(df, "time_series_prophet").collect()}
    assert checks == {"sample_size": False, "temporal_gaps": False}


def test_quality_score(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, 1.0, "a"), (2, None, "b"), (3, 2.0, "c")], "i int, v double, s string")
    r = profile.profile_summary(df).first()
    assert (r["quality_score"], r["total_missing"], r["duplicate_rows"]) == (86.7, 1, 1)


def test_profile_of_nan_and_large_keys(spark):
    df = spark.createDataFrame([(2**60, float("nan")), (2**60 + 1, 1.0)], "k long, v double")
    got = {r["column"]: (r["missing"], r["unique"]) for r in profile.profile_columns(df).collect()}
    assert got == {"k": (0, 2), "v": (1, 1)}


def test_normality_of_known_samples(spark):
    weights = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rows = [("weights", float(w)) for w in weights] + [("same", 3.0)] * 20 + [("few", 1.0), ("few", 2.0)]
    got = {r.column: r for r in normality(spark.createDataFrame(rows, "column string, v double")).collect()}
    scores = [NormalDist().inv_cdf((i - 0.375) / 11.25) for i in range(1, 12)]
    w = np.corrcoef(scores, weights)[0, 1] ** 2
    assert abs(got["weights"].w_stat - w) < 1e-7 and 0.002 < got["weights"].p_value < 0.02 and got["weights"].n == 11
    assert got["same"].p_value == 1.0 and got["few"].p_value == 1.0


def test_zscore_of_a_constant_column(spark):
    df = spark.createDataFrame([(i, 5.0, 100.0 if i == 0 else 0.0) for i in range(50)], "id int, c double, v double")
    got = {r["column"]: r["anomalies"] for r in anomaly.z_score_summary(df, ["c", "v"]).collect()}
    assert got == {"(any)": 1, "v": 1}
    top = anomaly.z_score_top(df, ["c", "v"], "id").first()
    assert top["id"] == 0 and top["max_z"] == pytest.approx(7.0)


def test_filter_is_a_case_insensitive_pattern(spark):
    df = spark.createDataFrame([("Apple",), ("pear",), (None,)], "f string")
    assert [r["f"] for r in relational.filter_contains(df, "f", "^AP").collect()] == ["Apple"]


def test_log_rank_two_groups(spark):
    rows = [(1, 1, "a"), (2, 1, "a"), (3, 0, "a"), (4, 1, "b"), (5, 1, "b"), (6, 0, "b")]
    r = survival.log_rank(spark.createDataFrame(rows, "t int, e int, g string"), "t", "e", "g").orderBy("group").first()
    expected = 3 / 6 + 2 / 5 + 0
    variance = 3 / 6 * 3 / 6 + 2 / 5 * 3 / 5
    assert r["observed"] == 2 and r["expected"] == pytest.approx(expected)
    assert r["chi2"] == pytest.approx((2 - expected) ** 2 / variance)


def test_date_strings(spark):
    df = spark.createDataFrame([("2024-01-05", "x"), ("01/06/2024", "y"), ("7 Jan 2024", "z")], "d string, s string")
    assert relational.date_columns(df) == ["d"]
    days = [r[0].day for r in df.select(relational.as_timestamp(df, "d")).orderBy(F.col("s")).collect()]
    assert days == [5, 6, 7]


def test_degenerate_inputs_give_nulls(spark):
    rows = spark.createDataFrame([(float(i), 3.0, 2.0 * i, "ab"[i % 2]) for i in range(20)], "x double, same double, y double, g string")
    pairs = {(r.col1, r.col2): (r.pearson, r.spearman) for r in correlation.correlation_pairs(rows, ["x", "same", "y"]).collect()}
    assert pairs["x", "same"] == (None, None) and pairs["same", "y"] == (None, None)
    assert all(abs(v - 1) < 1e-9 for v in pairs["x", "y"])
    zero = business.pareto(rows.select("g", (rows.x * 0).alias("v")), "g", "v").collect()
    assert [r.pct for r in zero] == [None, None] and not any(r.in_80 for r in zero)
    two = rows.limit(2)
    assert hypothesis.ttest(two, "x", "g").first().p_value is None and hypothesis.pairwise_comparison(two, "x", "g").first().t_stat is None
    metrics = regression.polynomial_fit(rows, "same", "x")["metrics"].collect()
    assert len(metrics) == 3 and all(r.r2 is None for r in metrics)
    names = rows.withColumn("name", F.concat(F.lit("n"), F.col("x")))
    assert hypothesis.pick_group(names.select("name", "x"), 3, at_least=True) is None


def test_ranks_of_a_hot_value_come_in_bounded_pieces(spark):
    rows = [("x", 1.0, 5, 5, 10_000_006), ("x", 2.0, 10_000_000, 10_000_005, 10_000_006), ("x", 3.0, 1, 10_000_006, 10_000_006)]
    pieces = rank_pieces(spark.createDataFrame(rows, "column string, v double, n long, _upto long, _all long"))
    got = sorted((r.v, r._from, r._to) for r in pieces.collect())
    assert all(0 <= to - start < PIECE for _, start, to in got)
    assert [start for _, start, _ in got] == [1] + [to + 1 for _, _, to in got][:-1] and got[-1][2] == 10_000_006
    assert {v: sum(to - start + 1 for w, start, to in got if w == v) for v in (1.0, 2.0, 3.0)} == {1.0: 5, 2.0: 10_000_000, 3.0: 1}


def test_contingency_grid_past_the_pivot_limit(spark):
    old = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "5")
    try:
        df = spark.createDataFrame([(str(i), "x" if i % 2 else "y") for i in range(20)], "k string, g string")
        assert hypothesis.contingency_grid(df, "g", "k").count() == 20
        assert hypothesis.contingency_grid(df, "k", "g").count() == 40
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", old)
