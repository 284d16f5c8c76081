"""Cleaning: finding issues and fixing duplicates and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from statloom.operators.counts import column_quantiles, duplicate_count, top_values, value_counts
from statloom.roles import number, quoted, roles

# Quartile fence and size thresholds (fixed values).
FENCE = 1.5
FENCE_MIN_VALUES = 10
ISSUE_SCHEMA = "column string, issue_type string, severity string, count long, auto_fixable boolean, fix_description string"


def duplicate_issue(df: DataFrame) -> DataFrame:
    found = duplicate_count(df).where("duplicates > 0")
    severity = F.when(F.col("duplicates") < F.col("rows") * 0.1, "medium").otherwise("high")
    return found.select(
        F.lit("(all)").alias("column"),
        F.lit("duplicates").alias("issue_type"),
        severity.alias("severity"),
        F.col("duplicates").alias("count"),
        F.lit(True).alias("auto_fixable"),
        F.format_string("Remove %d duplicate rows", "duplicates").alias("fix_description"),
    )


def missing_issues(df: DataFrame) -> DataFrame:
    """A row per column with missing values, from one aggregation."""
    numeric = set(roles(df).numeric)
    facts = []
    for i, c in enumerate(df.columns):
        value = number(c) if c in numeric else quoted(c)
        facts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit("median" if c in numeric else "mode").alias("fill"),
                F.count_if(value.isNull()).alias("count"),
                F.count("*").alias("rows"),
            ).alias(f"f{i}")
        )
    one = df.agg(*facts).select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(facts))])))
    share = F.col("count") / F.col("rows")
    severity = F.when(share > 0.3, "high").when(share > 0.1, "medium").otherwise("low")
    return one.where(F.col("count") > 0).select(
        "column",
        F.lit("missing_values").alias("issue_type"),
        severity.alias("severity"),
        "count",
        F.lit(True).alias("auto_fixable"),
        F.format_string("Fill %d missing values with %s", "count", "fill").alias("fix_description"),
    )


def outlier_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, lower, upper) quartile fences of columns with enough values and spread."""
    q = column_quantiles(df, columns, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.where((F.col("_n") > FENCE_MIN_VALUES) & (iqr > 0)).select(
        "column",
        (F.col("q1") - FENCE * iqr).alias("lower"),
        (F.col("q3") + FENCE * iqr).alias("upper"),
    )


def outlier_issues(df: DataFrame) -> DataFrame:
    """Counts outside the fences; the fences are at most one row per column."""
    columns = roles(df).numeric
    if not columns:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    long = df.select(*[number(c).alias(c) for c in columns]).unpivot(
        [], [quoted(c) for c in columns], "column", "v"
    )
    fences = F.broadcast(outlier_bounds(df, columns))
    outside = (F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))
    counted = long.join(fences, "column").groupBy("column").agg(F.count_if(outside).alias("count"))
    return counted.where(F.col("count") > 0).select(
        "column",
        F.lit("outliers").alias("issue_type"),
        F.lit("low").alias("severity"),
        "count",
        F.lit(False).alias("auto_fixable"),
        F.format_string("%d outliers detected (IQR method)", "count").alias("fix_description"),
    )


def detect_issues(df: DataFrame) -> DataFrame:
    return duplicate_issue(df).unionByName(missing_issues(df)).unionByName(outlier_issues(df))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fill_values(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Median of numeric columns, most frequent value (smallest on ties) of the others."""
    numeric = [c for c in columns if c in roles(df).numeric]
    other = [c for c in columns if c not in numeric]
    found: dict[str, object] = {}
    if numeric:
        for r in column_quantiles(df, numeric, {"median": 0.5}).collect():
            found[r["column"]] = r["median"]
    if other:
        for r in top_values(value_counts(df, other), 1).collect():
            found[r["column"]] = r["value"]
    return found


def fill_missing(df: DataFrame, columns: list[str], values: dict[str, object] | None = None) -> DataFrame:
    """Fill the columns; an integer column whose median is fractional becomes double."""
    values = fill_values(df, columns) if values is None else values
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        fill = values.get(f.name)
        if f.name in columns and fill is not None:
            if isinstance(f.dataType, (T.IntegralType, T.DecimalType)) and float(fill) != int(float(fill)):
                c = c.cast("double")
                c = F.coalesce(c, F.lit(float(fill)))
            elif isinstance(f.dataType, T.NumericType):
                if f.dataType.typeName() in ("double", "float"):
                    c = F.when(~F.isnan(c), c)
                c = F.coalesce(c, F.lit(fill).cast(f.dataType))
            else:
                c = F.coalesce(c, F.lit(fill).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def apply_all_fixes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Duplicates first, then missing values with statistics of what is left; plus a log."""
    issues = detect_issues(df)
    log = issues.select(
        "column", "issue_type", "count", F.when(F.col("auto_fixable"), "applied").otherwise("skipped").alias("outcome")
    )
    unique = drop_duplicate_rows(df)
    columns = [r["column"] for r in missing_issues(unique).select("column").collect()]
    return (fill_missing(unique, columns) if columns else unique), log
