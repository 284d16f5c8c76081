import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.plans import batch, catalogue, results, validation
from statloom.plans.confidence import confidence
from statloom.plans.saved import SavedPlans


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(42)
    n = 160
    small = pd.DataFrame(
        {
            "amount": rng.uniform(10, 1000, n).round(2),
            "quantity": rng.integers(1, 20, n),
            "rating": rng.normal(size=n),
            "category": rng.choice(["A", "B", "C"], n),
            "region": rng.choice(["N", "S"], n),
            "is_returned": rng.integers(0, 2, n),
        }
    )
    days = pd.DataFrame(
        {"date": pd.date_range("2023-01-01", periods=n), "sales": rng.normal(size=n).cumsum() + 100, "visitors": rng.integers(50, 500, n)}
    )
    baskets = pd.DataFrame({"transaction_id": np.repeat(range(60), 4), "item": rng.choice(list("abcdef"), 240)})
    life = pd.DataFrame({"duration": rng.exponential(10, n).round(1), "event": (rng.random(n) < 0.7).astype(int), "arm": rng.choice(["x", "y"], n)})
    users = pd.DataFrame({"user_id": rng.integers(0, 20, n), "date": pd.date_range("2023-01-01", periods=n)})
    dated = lambda pdf: spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("timestamp_ntz"))
    return {
        "small": spark.createDataFrame(small),
        "days": dated(days),
        "baskets": spark.createDataFrame(baskets),
        "life": spark.createDataFrame(life),
        "users": dated(users),
    }


SOURCES = {
    "time_series_arima": "days",
    "time_series_prophet": "days",
    "granger_causality": "days",
    "survival_kaplan_meier": "life",
    "market_basket": "baskets",
    "cohort": "users",
}
# DBSCAN and the layouts have their own tests.
SLOW = {"clustering_dbscan", "tsne", "umap", "clustering_kmeans"}


@pytest.mark.parametrize("analysis_id", [i for i, _, _ in catalogue.METHODS if i not in SLOW])
def test_every_analysis_runs(spark, frames, analysis_id):
    params = {"feature_columns": ["amount", "quantity", "rating"]} if analysis_id == "pca" else {}
    outcome = catalogue.run_analysis(frames[SOURCES.get(analysis_id, "small")], analysis_id, params)
    assert outcome.success, outcome.error
    assert outcome.detail in outcome.tables and results.detail_table(outcome).limit(1).count() == 1
    if outcome.metrics:
        assert catalogue.metric_rows(spark, outcome).count() > 0


def test_registry_is_complete():
    assert set(catalogue.ANALYSES) == {i for i, _, _ in catalogue.METHODS} and len(catalogue.METHODS) == 25


def test_bad_input_fails_cleanly(spark, frames):
    assert catalogue.run_analysis(frames["small"], "nothing").error
    assert not catalogue.run_analysis(spark.createDataFrame([(1,), (2,)], "a int"), "clustering_dbscan").success
    missed = catalogue.run_analysis(frames["small"], "descriptive_stats", {"filter_column": "region", "filter_value": "zzz"})
    assert not missed.success


def test_layout_keeps_groups_together(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.3, (40, 4)) for c in (0, 6)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(id=range(80)))
    from statloom.operators.layout import neighbor_layout_2d

    p = neighbor_layout_2d(df, list("abcd"), "id", "perplexity", epochs=4).toPandas().sort_values("id")
    xy = p[["x", "y"]].to_numpy()
    gaps = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    np.fill_diagonal(gaps, np.inf)
    assert len(p) == 80 and np.isfinite(xy).all()
    assert ((gaps.argmin(1) < 40) == (np.arange(80) < 40)).mean() > 0.95


def test_validation(spark, frames):
    got = {r["analysis_id"]: r["status"] for r in validation.validate_all(frames["life"], {"group_column": "arm"}).collect()}
    assert len(got) == 25
    assert got["survival_kaplan_meier"] == got["ttest"] == "ok"
    assert got["time_series_arima"] == got["market_basket"] == got["cohort"] == got["anova"] == got["pca"] == "blocked"
    tiny = {r["analysis_id"]: r["status"] for r in validation.validate_all(frames["life"].limit(40)).collect()}
    assert tiny["regression_linear"] == "warning" and tiny["clustering_kmeans"] == "blocked"
    one = validation.validate(frames["small"], "ttest", {"group_column": "category"}).first()
    assert one["status"] == "preprocess" and one["suggestions"] == ["anova"]


def test_confidence(spark):
    rows = [(20, 0.6, 5, 0.1, None), (1000, 0.0, 0, 0.9, None), (200, 0.3, 1, None, 0.1)]
    df = spark.createDataFrame(rows, "rows long, missing_share double, failed long, r2 double, silhouette double")
    got = [(r["score"], len(r["reasons"])) for r in confidence(df).orderBy("rows").collect()]
    assert got == [(0.0, 4), (0.5, 3), (1.0, 0)]


def test_batch_saved_plan_and_log(spark, frames, tmp_path):
    plans = SavedPlans(spark, str(tmp_path / "plans"))
    assert plans.current().count() == 0
    plans.put("weekly", [("pareto", {})])
    plans.put("weekly", [("descriptive_stats", {}), ("anova", {}), ("gone", {"a": 1})], ["amount", "category", "absent"], "each Monday")
    assert [(r["plan"], r["note"]) for r in plans.current().collect()] == [("weekly", "each Monday")]
    run = batch.run_saved(frames["small"], plans, "weekly")
    assert [o.analysis_id for o in run.outcomes] == ["descriptive_stats", "anova"] and all(o.success for o in run.outcomes)
    assert {r["analysis_id"]: r["score"] for r in run.scores.collect()}["descriptive_stats"] == 0.9
    plans.retire("weekly")
    with pytest.raises(KeyError):
        plans.steps("weekly")
    results.write_results(run.outcomes, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/analysis_id=anova/test")).count() == 1
    log = results.ResultsLog(spark, str(tmp_path / "log"))
    kept, gone = log.create_session("a.csv", 160, 6), log.create_session("b.csv", 1, 1)
    for outcome in run.outcomes:
        log.save_result(kept, outcome)
    log.delete_session(gone)
    assert [r["session_id"] for r in log.recent_sessions().collect()] == [kept]
    found = log.findings(kept).collect()
    assert found[0]["finding"].startswith("rows: 160; columns: 2") and len(found) == 2
    assert log.compact(str(tmp_path / "log2")).results(kept).count() == 2


def test_user_analysis(spark, frames):
    catalogue.register_analysis("row_count", lambda df, p: ({"n": df.agg(F.count("*").alias("n"))}, "n", "n"))
    try:
        assert catalogue.run_analysis(frames["small"], "row_count").tables["n"].first()["n"] == 160
    finally:
        catalogue.ANALYSES.pop("row_count")
