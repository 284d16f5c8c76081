"""Can an analysis run on a table? One row per analysis: ok, warning, preprocess or blocked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from statloom.operators.relational import date_columns
from statloom.plans.catalogue import ANALYSES, LEAST_ROWS
from statloom.roles import ITEM_WORDS, TRANSACTION_WORDS, keyword_columns, normalise_params, number, quoted, roles

OK, WARNING, PREPROCESS, BLOCKED = "ok", "warning", "preprocess", "blocked"
SMALL_TABLE, SMALL_CLUSTERING = 100, 200
COHORT_SHARE = 0.9


@dataclass
class Facts:
    rows: int
    numeric: int
    categorical: int
    dates: int
    binary: bool
    duration_event: bool
    transactional: bool
    cohort: bool
    three_levels: bool
    group_levels: int = 0
    group: str | None = None


def collect_facts(df: DataFrame, params: dict | None = None) -> Facts:
    """Everything the rules need, from two aggregations without a shuffle of rows.

    A column has exactly two values when its minimum and maximum differ and nothing else occurs.
    That needs no distinct count.
    """
    p = normalise_params(params, df.columns)
    found = roles(df)
    columns = [c for c in df.columns if c not in found.other]
    value = lambda c: number(c) if c in found.numeric else quoted(c)
    first = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        first += [F.min(value(c)).alias(f"lo{i}"), F.max(value(c)).alias(f"hi{i}")]
        first.append(F.approx_count_distinct(quoted(c)).alias(f"d{i}"))
    ranges = df.agg(*first)
    second = []
    tagged = df.withColumn("_r", ranges.select(F.struct("*")).scalar())
    for i, c in enumerate(columns):
        v, lo, hi = value(c), F.col(f"_r.lo{i}"), F.col(f"_r.hi{i}")
        second.append(F.coalesce(F.bool_or((v != lo) & (v != hi)), F.lit(False)).alias(f"more{i}"))
        if c in found.numeric:
            second.append(F.coalesce(F.bool_and(v.isin(0.0, 1.0)), F.lit(False)).alias(f"flag{i}"))
    r, s = ranges.first(), tagged.agg(*second).first()
    at = {c: i for i, c in enumerate(columns)}
    spread = {c: r[f"lo{i}"] is not None and r[f"lo{i}"] != r[f"hi{i}"] for c, i in at.items()}
    more = {c: bool(s[f"more{i}"]) for c, i in at.items()}
    dates = date_columns(df)
    cohort = False
    if dates:
        limit = r["rows"] * COHORT_SHARE
        sure = [c for c in columns if spread[c] and r[f"d{at[c]}"] < 0.75 * limit]
        unsure = [c for c in columns if spread[c] and 0.75 * limit <= r[f"d{at[c]}"] <= 1.25 * limit]
        # Only a sketch near the limit needs an exact count.
        cohort = bool(sure) or any(df.agg(F.count_distinct(quoted(c))).first()[0] < limit for c in unsure)
    group = p.get("group_column")
    return Facts(
        rows=r["rows"],
        numeric=len(found.numeric),
        categorical=len(found.categorical),
        dates=len(dates),
        binary=any(spread[c] and not more[c] for c in columns),
        duration_event=any(r[f"lo{at[c]}"] is not None and r[f"lo{at[c]}"] >= 0 and more[c] for c in found.numeric)
        and any(s[f"flag{at[c]}"] for c in found.numeric),
        transactional=bool(keyword_columns(df.columns, TRANSACTION_WORDS)) and bool(keyword_columns(df.columns, ITEM_WORDS)),
        cohort=cohort,
        three_levels=any(spread[c] and more[c] for c in found.categorical),
        group_levels=(3 if more.get(group) else 2 if spread.get(group) else 1) if group else 0,
        group=group,
    )


Rule = tuple[set[str], Callable[[Facts], bool], str, str, list[str]]

SERIES = {"time_series_arima", "time_series_prophet", "granger_causality"}
LAYOUTS = {"pca", "tsne", "umap"}
MANY_NUMBERS = LAYOUTS | {
    "regression_linear",
    "regression_polynomial",
    "clustering_kmeans",
    "clustering_dbscan",
    "clustering_hierarchical",
    "anomaly_isolation_forest",
    "anomaly_zscore",
    "correlation",
}

# The first rule that names the analysis and whose condition fails decides.
RULES: list[Rule] = [
    (SERIES, lambda f: f.dates > 0, BLOCKED, "needs a date column", ["descriptive_stats", "correlation"]),
    (SERIES, lambda f: f.numeric > 0, BLOCKED, "needs a numeric column", ["descriptive_stats"]),
    ({"regression_logistic"}, lambda f: f.binary, BLOCKED, "needs a column with two values", ["regression_linear"]),
    (
        {"survival_kaplan_meier"},
        lambda f: f.duration_event,
        BLOCKED,
        "needs a non-negative duration and a 0/1 event",
        ["descriptive_stats"],
    ),
    (
        {"market_basket"},
        lambda f: f.transactional,
        BLOCKED,
        "needs a transaction id and an item column",
        ["chi_square", "correlation"],
    ),
    ({"cohort"}, lambda f: f.cohort, BLOCKED, "needs a user and a date column", ["descriptive_stats"]),
    ({"ttest", "mann_whitney"}, lambda f: f.group_levels <= 2, PREPROCESS, "group column has more than 2 groups", ["anova"]),
    (MANY_NUMBERS, lambda f: f.numeric >= 2, BLOCKED, "needs at least 2 numeric columns", ["descriptive_stats"]),
    (
        LAYOUTS,
        lambda f: f.numeric >= 3,
        BLOCKED,
        "needs at least 3 numeric columns",
        ["clustering_kmeans", "correlation"],
    ),
    ({"chi_square"}, lambda f: f.categorical >= 2, BLOCKED, "needs at least 2 categorical columns", ["correlation", "ttest"]),
    ({"anova"}, lambda f: f.three_levels, BLOCKED, "needs a group column with 3 or more values", ["ttest", "mann_whitney"]),
]


def judge(analysis_id: str, facts: Facts) -> tuple[str, str, list[str]]:
    if analysis_id not in ANALYSES:
        return BLOCKED, "unknown analysis", []
    least = LEAST_ROWS[analysis_id]
    if facts.rows < least:
        return BLOCKED, f"needs at least {least} rows, has {facts.rows}", ["descriptive_stats"]
    for ids, holds, status, message, instead in RULES:
        if analysis_id in ids and not holds(facts):
            return status, message, instead
    if facts.rows < SMALL_TABLE:
        return WARNING, f"small table of {facts.rows} rows", []
    if analysis_id.startswith("clustering_") and facts.rows < SMALL_CLUSTERING:
        return WARNING, f"clustering works better from {SMALL_CLUSTERING} rows, has {facts.rows}", []
    return OK, "ready", []


def validate(df: DataFrame, analysis_id: str, params: dict | None = None, facts: Facts | None = None) -> DataFrame:
    return _table(df, [analysis_id], facts or collect_facts(df, params))


def validate_all(df: DataFrame, params: dict | None = None) -> DataFrame:
    """A row per registered analysis; the facts are gathered once."""
    return _table(df, list(ANALYSES), collect_facts(df, params))


def _table(df: DataFrame, ids: list[str], facts: Facts) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, *judge(i, facts)) for i in ids],
        "analysis_id string, status string, message string, suggestions array<string>",
    )
