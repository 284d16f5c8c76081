"""Statistical assumption checks before an analysis; they warn and never stop a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from statloom.functions.ordered import prefix_sum
from statloom.functions.special import normal_quantile, normal_two_sided
from statloom.operators.anomaly import Z_LIMIT
from statloom.operators.hypothesis import levene
from statloom.operators.regression import vif
from statloom.operators.series import date_gaps
from statloom.roles import normalise_params, number, quoted, roles
from statloom.session import cut_lineage

CHECK_SCHEMA = "test string, column string, stat double, p_value double, passed boolean, message string"
COLUMNS = ["test", "column", "stat", "p_value", "passed", "message"]

# Limits (fixed values).
ALPHA = 0.05
VIF_LIMIT = 10
ROWS_PER_FEATURE = 10
IMBALANCE_LIMIT = 10
MINORITY_ROWS = 50
SCALE_LIMIT = 10
OUTLIER_SHARE = 0.10
SERIES_ROWS = 30
GAP_FACTOR = 10
FOREST_ROWS = 50

# Royston (1993): mean and spread of log(1 - W') by log n (fixed values).
LOG_MEAN = (-1.2725, 1.0521)
LOG_SPREAD = (1.0308, -0.26758)

# Ranks of one value that are spread to rows at a time (fixed value).
PIECE = 4096


def rank_pieces(ranked: DataFrame) -> DataFrame:
    """(column, v, _all, _from, _to): the ranks of each value in pieces of PIECE at most, dealt to all tasks."""
    begins = F.sequence(F.col("_upto") - F.col("n") + 1, F.col("_upto"), F.lit(PIECE).cast("long"))
    return (
        ranked.select("column", "v", "_all", "_upto", F.explode(begins).alias("_from"))
        .repartition("column", "v", "_from")
        .select("column", "v", "_all", "_from", F.least(F.col("_from") + (PIECE - 1), F.col("_upto")).alias("_to"))
    )


def normality(values: DataFrame) -> DataFrame:
    """(column, w_stat, p_value, n) of (column, v) rows by the Shapiro-Francia test over all rows.

    W' is the squared correlation of the ordered values with normal scores. Distinct values get their
    ranks by a distributed prefix sum, each rank its score, and sums per column are all that is
    shuffled after that. Below five values or without spread nothing speaks against normality.
    """
    counts = values.where("v is not null").groupBy("column", "v").agg(F.count("*").alias("n"))
    ranked = prefix_sum(counts, ["v"], {"_upto": "n"}, ["column"], {"_all": "n"})
    rank = F.explode(F.sequence("_from", "_to"))
    scored = rank_pieces(ranked).select("column", "v", "_all", rank.alias("_rank")).withColumn(
        "m", normal_quantile((F.col("_rank") - 0.375) / (F.col("_all") + 0.25))
    )
    sums = scored.groupBy("column").agg(
        F.max("_all").alias("n"),
        F.covar_pop("v", "m").alias("_vm"),
        F.var_pop("v").alias("_vv"),
        F.var_pop("m").alias("_mm"),
    )
    w = F.coalesce(F.try_divide(F.col("_vm") ** 2, F.nullif(F.col("_vv") * F.col("_mm"), F.lit(0.0))), F.lit(1.0))
    size = F.log(F.col("n").cast("double"))
    mean = LOG_MEAN[0] + LOG_MEAN[1] * (F.log(size) - size)
    spread = LOG_SPREAD[0] + LOG_SPREAD[1] * (F.log(size) + 2 / size)
    z = (F.log(F.greatest(1 - F.col("w_stat"), F.lit(1e-300))) - mean) / spread
    upper = F.when(z > 0, normal_two_sided(z) / 2).otherwise(1 - normal_two_sided(z) / 2)
    tested = (F.col("n") >= 5) & (F.col("w_stat") < 1)
    return sums.withColumn("w_stat", F.least(w, F.lit(1.0))).select(
        "column", "w_stat", F.when(tested, upper).otherwise(1.0).alias("p_value"), "n"
    )


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[number(c).alias(c) for c in columns]).unpivot([], [quoted(c) for c in columns], "column", "v")


def _check(rows: DataFrame, test: str, column, stat, p, passed, message) -> DataFrame:
    as_column = lambda x: F.lit(x) if x is None or isinstance(x, (str, bool)) else x
    return rows.select(
        F.lit(test).alias("test"),
        as_column(column).alias("column"),
        stat.cast("double").alias("stat"),
        as_column(p).cast("double").alias("p_value"),
        as_column(passed).alias("passed"),
        message.alias("message"),
    )


def _normality_check(df: DataFrame, columns: list[str], only_failed: bool) -> DataFrame:
    found = normality(_long(df, columns))
    ok = F.col("p_value") >= ALPHA
    rows = _check(
        found,
        "shapiro_francia",
        F.col("column"),
        F.round("w_stat", 4),
        F.round("p_value", 4),
        ok,
        F.format_string("normality of %s: W=%.3f, p=%.4f", "column", "w_stat", "p_value"),
    )
    return rows.where("not passed") if only_failed else rows


def check_linear(df: DataFrame, p: dict) -> list[DataFrame]:
    numeric = roles(df).numeric
    target = p.get("target_column") or (numeric[-1] if numeric else None)
    if not target:
        return []
    features = [f for f in (p.get("feature_columns") or numeric) if f != target]
    out = [_normality_check(df, [target], False)]
    if len(features) >= 2:
        high = vif(df, features).where(F.col("vif") > VIF_LIMIT)
        out.append(
            _check(
                high, "vif", F.col("column"), F.round("vif", 2), None, False,
                F.format_string("%s is explained by the other features: VIF %.1f", "column", "vif"),
            )
        )
    need = len(features) * ROWS_PER_FEATURE
    if need:
        counted = df.agg(F.count(number(target)).alias("n")).where(F.col("n") < need)
        out.append(
            _check(
                counted, "sample_size", target, F.col("n"), None, False,
                F.format_string(f"%d rows for {len(features)} features, {need} advised", "n"),
            )
        )
    return out


def check_logistic(df: DataFrame, p: dict) -> list[DataFrame]:
    target = p.get("target_column")
    if not target:
        return []
    counts = df.where(quoted(target).isNotNull()).groupBy(quoted(target)).agg(F.count("*").alias("n"))
    both = counts.agg(F.count("*").alias("k"), F.max("n").alias("hi"), F.min("n").alias("lo")).where("k >= 2")
    ratio = F.col("hi") / F.col("lo")
    return [
        _check(
            both.where(ratio > IMBALANCE_LIMIT), "class_balance", target, F.round(ratio, 1), None, False,
            F.format_string("classes are unbalanced, %.0f to 1", ratio),
        ),
        _check(
            both.where(F.col("lo") < MINORITY_ROWS), "sample_size", target, F.col("lo"), None, False,
            F.format_string(f"smallest class has %d rows, {MINORITY_ROWS} advised", "lo"),
        ),
    ]


def check_anova(df: DataFrame, p: dict, least: int = 5) -> list[DataFrame]:
    numeric = roles(df).numeric
    group, value = p.get("group_column"), p.get("target_column") or (numeric[-1] if numeric else None)
    if not group or not value:
        return []
    sizes = df.where(quoted(group).isNotNull()).groupBy(quoted(group).alias("g")).agg(F.count("*").alias("n"))
    chosen = sizes.where(F.col("n") >= least).select("g")
    rows = df.select(quoted(group).alias("g"), number(value).alias("v")).join(chosen, "g")
    tests = normality(rows.select(F.col("g").cast("string").alias("column"), "v"))
    bad = tests.agg(F.count("*").alias("k"), F.count_if(F.col("p_value") < ALPHA).alias("bad")).where("k >= 2 and bad > 0")
    spread = levene(df, value, group, least).where("groups >= 2 and p_value is not null")
    return [
        _check(
            bad, "shapiro_francia", value, F.col("bad"), None, False,
            F.format_string("%d of %d groups are not normal; consider a rank test", "bad", "k"),
        ),
        _check(
            spread, "levene", value, F.round("w_stat", 4), F.round("p_value", 4), F.col("p_value") >= ALPHA,
            F.format_string("equal variances: p=%.4f", "p_value"),
        ),
    ]


def check_correlation(df: DataFrame, p: dict) -> list[DataFrame]:
    columns = p.get("feature_columns") or roles(df).numeric
    return [_normality_check(df, columns, True)] if columns else []


def check_kmeans(df: DataFrame, p: dict) -> list[DataFrame]:
    columns = p.get("feature_columns") or roles(df).numeric
    if not columns:
        return []
    facts = []
    for i, c in enumerate(columns):
        facts += [F.stddev_samp(number(c)).alias(f"s{i}"), F.avg(number(c)).alias(f"m{i}"), F.stddev_pop(number(c)).alias(f"q{i}")]
    one = df.agg(*facts)
    stds = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)])))
    scale = stds.agg(F.max("s").alias("hi"), F.min("s").alias("lo"), F.max_by("column", "s").alias("c"))
    ratio = F.col("hi") / F.col("lo")
    out = [
        _check(
            scale.where((F.col("lo") > 0) & (ratio > SCALE_LIMIT)), "feature_scaling", F.col("c"), F.round(ratio, 1), None, False,
            F.format_string("scales differ by a factor of %.0f; columns are standardised", ratio),
        )
    ]
    tagged = df.withColumn("_f", one.select(F.struct("*")).scalar())
    shares = []
    for i, c in enumerate(columns):
        z = F.abs(number(c) - F.col(f"_f.m{i}")) / F.nullif(F.col(f"_f.q{i}"), F.lit(0.0))
        shares.append(
            F.struct(
                F.lit(c).alias("column"),
                (F.count_if(z > Z_LIMIT) / F.nullif(F.count(number(c)), F.lit(0))).alias("share"),
                F.count(number(c)).alias("n"),
            ).alias(f"o{i}")
        )
    outliers = tagged.agg(*shares).select(F.inline(F.array(*[F.col(f"o{i}") for i in range(len(shares))])))
    outliers = outliers.where((F.col("n") >= 3) & (F.col("share") > OUTLIER_SHARE))
    out.append(
        _check(
            outliers, "outlier", F.col("column"), F.round(F.col("share") * 100, 1), None, False,
            F.format_string("%s: %.1f%% extreme values", "column", F.col("share") * 100),
        )
    )
    return out


def check_series(df: DataFrame, p: dict) -> list[DataFrame]:
    from statloom.operators.relational import date_columns

    date = p.get("date_column") or (date_columns(df) or [None])[0]
    if not date:
        return []
    gaps = cut_lineage(date_gaps(df, date))  # one row for both checks
    few = F.col("n") < SERIES_ROWS
    return [
        _check(
            gaps.where(few), "sample_size", date, F.col("n"), None, False,
            F.format_string(f"%d points, {SERIES_ROWS} advised", "n"),
        ),
        _check(
            gaps.where(F.col("max_gap") > F.col("median_gap") * GAP_FACTOR), "temporal_gaps", date, F.floor("max_gap"), None, False,
            F.format_string("largest gap %.1f days, median %.1f", "max_gap", "median_gap"),
        ),
    ]


def check_forest(df: DataFrame, p: dict) -> list[DataFrame]:
    counted = df.agg(F.count("*").alias("n")).where(F.col("n") < FOREST_ROWS)
    return [
        _check(counted, "sample_size", "dataset", F.col("n"), None, False, F.format_string(f"%d rows, {FOREST_ROWS} advised", "n"))
    ]


CHECKS = {
    "regression_linear": check_linear,
    "regression_logistic": check_logistic,
    "anova": check_anova,
    "correlation": check_correlation,
    "clustering_kmeans": check_kmeans,
    "time_series_prophet": check_series,
    "time_series_arima": check_series,
    "anomaly_isolation_forest": check_forest,
}


def check_assumptions(df: DataFrame, analysis_id: str, params: dict | None = None) -> DataFrame:
    """All checks of one analysis; none for analyses without assumptions."""
    p = normalise_params(params, df.columns)
    parts = CHECKS[analysis_id](df, p) if analysis_id in CHECKS else []
    if not parts:
        return df.sparkSession.createDataFrame([], CHECK_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def guardrail_summary(checks: DataFrame, analysis_id: str) -> DataFrame:
    """(analysis_id, passed, failed, disclaimer) of one analysis."""
    title = analysis_id.replace("_", " ").title()
    lines = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("message"))))
    return checks.agg(
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        lines.alias("_l"),
    ).select(
        F.lit(analysis_id).alias("analysis_id"),
        "passed",
        "failed",
        F.when(F.col("passed"), "")
        .otherwise(F.concat(F.lit(f"Running {title}, note:\n"), F.array_join("_l", "\n")))
        .alias("disclaimer"),
    )
