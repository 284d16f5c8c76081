"""The catalogue of analyses: ids, names, least rows, and the function behind each id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from statloom.operators import (
    anomaly,
    basket,
    business,
    cluster,
    correlation,
    dbscan,
    describe,
    hypothesis,
    layout,
    regression,
    relational,
    series,
    survival,
)
from statloom.roles import feature_list, normalise_params, quoted, roles

# (id, name, least rows) (fixed values).
METHODS = [
    ("descriptive_stats", "Descriptive Statistics", 1),
    ("correlation", "Correlation Analysis", 10),
    ("ttest", "T-Test", 10),
    ("anova", "ANOVA", 20),
    ("chi_square", "Chi-Square Test", 20),
    ("mann_whitney", "Mann-Whitney U Test", 10),
    ("regression_linear", "Linear Regression", 30),
    ("regression_logistic", "Logistic Regression", 50),
    ("regression_polynomial", "Polynomial Regression", 20),
    ("clustering_kmeans", "K-Means Clustering", 50),
    ("clustering_dbscan", "DBSCAN Clustering", 50),
    ("clustering_hierarchical", "Hierarchical Clustering", 20),
    ("time_series_arima", "ARIMA Forecast", 50),
    ("time_series_prophet", "Prophet Forecast", 100),
    ("granger_causality", "Granger Causality", 50),
    ("pca", "PCA", 30),
    ("tsne", "t-SNE", 50),
    ("umap", "UMAP", 50),
    ("anomaly_isolation_forest", "Anomaly Detection (Isolation Forest)", 50),
    ("anomaly_zscore", "Anomaly Detection (Z-Score)", 20),
    ("survival_kaplan_meier", "Kaplan-Meier Survival Analysis", 30),
    ("market_basket", "Market Basket Analysis", 100),
    ("pareto", "Pareto Analysis (80/20)", 5),
    ("cohort", "Cohort Analysis", 100),
    ("ai_custom_reasoning", "AI Custom Reasoning", 1),
]
NAMES = {i: name for i, name, _ in METHODS}
LEAST_ROWS = {i: rows for i, _, rows in METHODS}

Tables = dict[str, DataFrame]


@dataclass
class Outcome:
    """Result tables of one analysis; ``metrics`` holds its headline numbers, ``detail`` names its main table."""

    analysis_id: str
    tables: Tables = field(default_factory=dict)
    metrics: str | None = None
    detail: str | None = None
    error: str | None = None

    @property
    def success(self) -> bool:
        return self.error is None

    @property
    def name(self) -> str:
        return NAMES.get(self.analysis_id, self.analysis_id)


ROW_ID = "_row_id"


def _with_row_id(df: DataFrame) -> DataFrame:
    """A row number per file position, for analyses that report rows of a table without a key."""
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def _key(df: DataFrame, params: dict) -> tuple[DataFrame, str]:
    key = params.get("key_column")
    return (df, key) if key in df.columns else (_with_row_id(df), ROW_ID)


def _target_and_group(df: DataFrame, params: dict, levels: int, at_least: bool = False) -> tuple[str, str]:
    numeric = roles(df).numeric
    target = params.get("target_column") or (numeric[0] if numeric else None)
    group = params.get("group_column") or hypothesis.pick_group(df, levels, at_least)
    if not target or not group:
        raise ValueError("need a numeric target and a group column")
    return target, group


def _descriptive(df, p):
    target, group = p.get("target_column"), p.get("group_column")
    found = roles(df)
    out: Tables = {"overview": describe.overview(df)}
    if found.numeric:
        out["describe"] = describe.describe(df)
        out["shape"] = describe.shape_statistics(df)
    if found.categorical:
        chosen = [target] if target in found.categorical else [group] if group in found.categorical else None
        out["categorical"] = describe.frequencies(df, chosen)
    if target and group and target != group and group in found.categorical:
        if target in found.numeric:
            out["boxes"] = describe.group_boxes(df, target, group)
        elif target in found.categorical:
            out["pairs"] = describe.category_counts(df, group, target)
    else:
        column = target or (found.numeric + found.categorical or [None])[0]
        if column in found.numeric:
            out["histogram"] = describe.histogram(df, column)
        elif column in found.categorical:
            out["top_values"] = describe.top_frequencies(df, column)
    return out, "overview", "describe" if found.numeric else "categorical"


def _correlation(df, p):
    columns = feature_list(df, p)
    if len(columns) < 2:
        raise ValueError("need at least 2 numeric columns")
    pairs = correlation.correlation_pairs(df, columns)
    top = correlation.top_pairs(pairs)
    return {"pairs": pairs, "top_pairs": top, "heat_map": correlation.heat_map(pairs, columns)}, None, "top_pairs"


def _ttest(df, p):
    target, group = _target_and_group(df, p, 2)
    return {"test": hypothesis.ttest(df, target, group), "boxes": describe.group_boxes(df, target, group)}, "test", "boxes"


def _anova(df, p):
    target, group = _target_and_group(df, p, 3, at_least=True)
    return {
        "test": hypothesis.anova(df, target, group),
        "pairwise": hypothesis.tukey_hsd(df, target, group),
        "boxes": describe.group_boxes(df, target, group),
    }, "test", "boxes"


def _chi_square(df, p):
    found = roles(df).categorical
    if len(found) < 2:
        raise ValueError("need at least 2 categorical columns")
    a, b = p.get("group_column") or found[0], p.get("target_column") or found[1]
    return {"test": hypothesis.chi_square(df, a, b), "heat_map": hypothesis.contingency_grid(df, a, b)}, "test", "heat_map"


def _mann_whitney(df, p):
    target, group = _target_and_group(df, p, 2)
    return {
        "test": hypothesis.mann_whitney(df, target, group),
        "boxes": describe.group_boxes(df, target, group),
    }, "test", "boxes"


def _linear(df, p):
    target, features = regression.default_columns(df, p)
    fit = regression.linear_fit(df, target, features, p.get("key_column"))
    fit["top_coefficients"] = regression.top_coefficients(fit["coefficients"])
    return fit, "metrics", "coefficients"


def _logistic(df, p):
    numeric = roles(df).numeric
    target = p.get("target_column") or regression.binary_target(df, numeric)
    if not target:
        raise ValueError("need a 0/1 target column")
    features = p.get("feature_columns") or [c for c in numeric if c != target]
    fit = regression.logistic_fit(df, target, features, p.get("key_column"))
    return fit, "metrics", "coefficients"


def _polynomial(df, p):
    target, features = regression.default_columns(df, p)
    fit = regression.polynomial_fit(df, target, features[0], p.get("key_column"))
    return fit, "best", "metrics"


def _numeric(df, p, least):
    columns = feature_list(df, p)
    if len(columns) < least:
        raise ValueError(f"need at least {least} numeric columns")
    return columns


def _kmeans(df, p):
    keyed, key = _key(df, p)
    return cluster.kmeans(keyed, _numeric(df, p, 2), [key]), "metrics", "sizes"


def _dbscan(df, p):
    keyed, key = _key(df, p)
    return dbscan.dbscan(keyed, _numeric(df, p, 2), key), "metrics", "sizes"


def _hierarchical(df, p):
    keyed, key = _key(df, p)
    return cluster.hierarchical(keyed, _numeric(df, p, 2), [key]), "sizes", "sizes"


def _arima(df, p):
    date, target = series.series_columns(df, p)
    daily = series.aggregate_by_date(df, date, target)
    best = series.arima(daily)
    forecast = series.arima_forecast(best)
    return {
        "metrics": best.select("p", "d", "q", "aic", "rmse"),
        "stationarity": series.adf(daily),
        "forecast": forecast,
        "months": series.peak_and_low(series.month_summary(forecast)),
    }, "metrics", "forecast"


def _additive(df, p):
    date, target = series.series_columns(df, p)
    forecast = series.additive_forecast(series.aggregate_by_date(df, date, target))
    return {"metrics": series.forecast_summary(forecast), "forecast": forecast}, "metrics", "forecast"


def _granger(df, p):
    numeric = roles(df).numeric
    if len(numeric) < 2:
        raise ValueError("need at least 2 numeric columns")
    date, _ = series.series_columns(df, p)
    effect = p.get("target_column") or numeric[0]
    cause = (p.get("feature_columns") or [c for c in numeric if c != effect])[0]
    return {"test": series.granger(df, date, effect, cause)}, None, "test"


def _pca(df, p):
    keyed, key = _key(df, p)
    return cluster.pca(keyed, _numeric(df, p, 3), [key]), None, "variance"


def _layout(weighting):
    def run(df, p):
        keyed, key = _key(df, p)
        return {"layout": layout.neighbor_layout_2d(keyed, _numeric(df, p, 3), key, weighting)}, None, "layout"

    return run


def _isolation(df, p):
    keyed, key = _key(df, p)
    scores = anomaly.isolation_scores(keyed, _numeric(df, p, 2), [key])
    return {
        "metrics": anomaly.isolation_summary(scores),
        "top_anomalies": anomaly.isolation_top(scores, key),
        "histogram": anomaly.score_histogram(scores, "score"),
    }, "metrics", "top_anomalies"


def _zscore(df, p):
    keyed, key = _key(df, p)
    columns = _numeric(df, p, 1)
    return {
        "per_column": anomaly.z_score_summary(df, columns),
        "top_anomalies": anomaly.z_score_top(keyed, columns, key),
        "histogram": anomaly.score_histogram(anomaly.z_scores(df, columns), "max_z"),
    }, None, "top_anomalies"


def _survival(df, p):
    duration, event = survival.survival_columns(df, p)
    curve = survival.kaplan_meier(df, duration, event)
    out = {"metrics": survival.survival_summary(curve), "curve": curve}
    if p.get("group_column"):
        out["log_rank"] = survival.log_rank(df, duration, event, p["group_column"])
    return out, "metrics", "curve"


def _basket(df, p):
    transaction, item = basket.basket_columns(df, p)
    sets = basket.frequent_itemsets(df, transaction, item)
    rules = basket.association_rules(sets)
    return {"itemsets": sets, "rules": rules, "top_rules": basket.top_rules(rules)}, None, "top_rules"


def _pareto(df, p):
    found = roles(df)
    category = p.get("group_column") or p.get("target_column") or (found.categorical or [None])[0]
    value = (p.get("feature_columns") or found.numeric or [None])[0]
    if not category or not value:
        raise ValueError("need a category and a value column")
    table = business.pareto(df, category, value)
    return {
        "metrics": business.pareto_summary(table),
        "pareto": table,
        "top_items": business.pareto_top(table),
    }, "metrics", "top_items"


def _cohort(df, p):
    user, date = business.cohort_columns(df, p)
    table = business.cohort(df, user, date)
    totals = table.where("period = 0").agg(F.count("*").alias("cohorts"), F.sum("users").alias("total_users"))
    return {"metrics": totals, "retention": table}, "metrics", "retention"


def _sample(df, p):
    keyed, key = _key(df, p)
    sample = relational.random_rows(keyed, key)
    counted = df.agg(F.count("*").alias("rows")).withColumn("sample_rows", F.least(F.col("rows"), F.lit(20)))
    return {"metrics": counted, "sample": sample.drop(ROW_ID)}, "metrics", "sample"


ANALYSES: dict[str, Callable[[DataFrame, dict], tuple[Tables, str | None, str | None]]] = {
    "descriptive_stats": _descriptive,
    "correlation": _correlation,
    "ttest": _ttest,
    "anova": _anova,
    "chi_square": _chi_square,
    "mann_whitney": _mann_whitney,
    "regression_linear": _linear,
    "regression_logistic": _logistic,
    "regression_polynomial": _polynomial,
    "clustering_kmeans": _kmeans,
    "clustering_dbscan": _dbscan,
    "clustering_hierarchical": _hierarchical,
    "time_series_arima": _arima,
    "time_series_prophet": _additive,
    "granger_causality": _granger,
    "pca": _pca,
    "tsne": _layout("perplexity"),
    "umap": _layout("uniform"),
    "anomaly_isolation_forest": _isolation,
    "anomaly_zscore": _zscore,
    "survival_kaplan_meier": _survival,
    "market_basket": _basket,
    "pareto": _pareto,
    "cohort": _cohort,
    "ai_custom_reasoning": _sample,
}


def register_analysis(analysis_id: str, run: Callable, name: str | None = None, least_rows: int = 1) -> None:
    """Add a user analysis: ``run(df, params) -> (tables, metrics table name, detail table name)``."""
    ANALYSES[analysis_id] = run
    NAMES[analysis_id] = name or analysis_id
    LEAST_ROWS[analysis_id] = least_rows


def run_analysis(df: DataFrame, analysis_id: str, params: dict | None = None) -> Outcome:
    """Run one analysis. Unusable input gives an unsuccessful outcome instead of an exception."""
    if analysis_id not in ANALYSES:
        return Outcome(analysis_id, error=f"unknown analysis {analysis_id!r}")
    p = normalise_params(params, df.columns)
    try:
        if p.get("filter_column") and p.get("filter_value") is not None:
            df = relational.filter_contains(df, p["filter_column"], p["filter_value"])
            if df.limit(1).count() == 0:
                raise ValueError(f"no row matches {p['filter_column']} ~ {p['filter_value']!r}")
        tables, metrics, detail = ANALYSES[analysis_id](df, p)
        return Outcome(analysis_id, tables, metrics, detail)
    except Exception as e:
        return Outcome(analysis_id, error=f"{type(e).__name__}: {e}")


def metric_rows(spark: SparkSession, outcome: Outcome) -> DataFrame:
    """Long (analysis_id, position, metric, value) form of the headline numbers."""
    schema = "analysis_id string, position int, metric string, value string"
    if not outcome.success or outcome.metrics is None:
        return spark.createDataFrame([], schema)
    table = outcome.tables[outcome.metrics]
    if table.columns[:2] == ["metric", "value"]:
        table = table.withColumn("_p", F.monotonically_increasing_id())
        return table.select(
            F.lit(outcome.analysis_id).alias("analysis_id"),
            F.col("_p").cast("int").alias("position"),
            "metric",
            F.col("value").cast("string").alias("value"),
        )
    flat = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("metric"), quoted(c).cast("string").alias("value")) for i, c in enumerate(table.columns)]
    return table.limit(1).select(F.lit(outcome.analysis_id).alias("analysis_id"), F.inline(F.array(*flat)))


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, NAMES[i], LEAST_ROWS[i]) for i in ANALYSES], "analysis_id string, name string, least_rows int"
    )
