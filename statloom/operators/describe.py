"""Descriptive statistics and the numbers behind their charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statloom.functions.ordered import weighted_quantiles
from statloom.operators.counts import column_quantiles, number_counts, top_values, value_counts
from statloom.operators.profile import numeric_moments, profile_summary
from statloom.roles import number, quoted, roles


def overview(df: DataFrame) -> DataFrame:
    """(metric, value) totals of the table."""
    names = {
        "rows": "row_count",
        "columns": "col_count",
        "numeric_columns": "numeric_columns",
        "categorical_columns": "categorical_columns",
        "missing_values": "total_missing",
        "duplicate_rows": "duplicate_rows",
    }
    one = profile_summary(df).select(*[F.col(c).cast("long").alias(n) for n, c in names.items()])
    return one.unpivot([], list(names), "metric", "value")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles (linear), max per numeric column."""
    columns = columns or roles(df).numeric
    quartiles = column_quantiles(df, columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("_n")
    return quartiles.join(F.broadcast(numeric_moments(df, columns)), "column")


def frequencies(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """Top values of the categorical columns with unique and present counts."""
    columns = columns or roles(df).categorical
    counts = value_counts(df, columns)
    totals = (
        counts.where("value is not null")
        .groupBy("column")
        .agg(F.count("*").alias("unique_count"), F.sum("n").alias("total_non_null"))
    )
    # A row per column.
    return top_values(counts, k).join(F.broadcast(totals), "column")


def group_boxes(df: DataFrame, value: str, group: str) -> DataFrame:
    """Five-number summary per group with whiskers at the last value within 1.5 IQR."""
    counts = (
        df.select(quoted(group).alias("grp"), number(value).alias("v"))
        .where("grp is not null and v is not null")
        .groupBy("grp", "v")
        .agg(F.count("*").alias("n"))
    )
    fives = weighted_quantiles(
        counts, "v", {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}, ["grp"]
    )
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("v") >= F.col("q1") - 1.5 * iqr) & (F.col("v") <= F.col("q3") + 1.5 * iqr)
    whiskers = (
        counts.join(fives, "grp")
        .where(inside)
        .groupBy("grp")
        .agg(F.min("v").alias("whisker_low"), F.max("v").alias("whisker_high"))
    )
    return fives.withColumnRenamed("_n", "count").join(whiskers, "grp").withColumnRenamed("grp", "group")


def category_counts(df: DataFrame, group: str, target: str) -> DataFrame:
    return df.groupBy(quoted(group).alias("group"), quoted(target).alias("target")).agg(F.count("*").alias("count"))


def shape_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """variance, IQR, population skewness and kurtosis, mode per numeric column."""
    columns = columns or roles(df).numeric
    aggregates = []
    for i, c in enumerate(columns):
        v = number(c)
        aggregates.append(
            F.struct(
                F.lit(c).alias("column"),
                F.var_samp(v).alias("variance"),
                F.skewness(v).alias("skewness"),
                F.kurtosis(v).alias("kurtosis"),
            ).alias(f"m{i}")
        )
    moments = df.agg(*aggregates).select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(columns))])))
    counts = number_counts(df, columns)
    spread = weighted_quantiles(counts, "number", {"q1": 0.25, "q3": 0.75}, ["column"])
    modes = counts.groupBy("column").agg(F.max_by("number", F.struct("n", -F.col("number"))).alias("mode"))
    return (
        spread.select("column", (F.col("q3") - F.col("q1")).alias("iqr"))
        .join(F.broadcast(moments), "column")
        .join(F.broadcast(modes), "column")
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, count) over equal-width bins; the last bin is closed."""
    values = df.select(number(column).alias("v")).where("v is not null")
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranged = values.withColumn("e", edges.select(F.struct("lo", "hi")).scalar())
    return _binned(ranged.select("v", "e.lo", "e.hi"), bins)


def _binned(values: DataFrame, bins: int) -> DataFrame:
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.floor((F.col("v") - F.col("lo")) / width)).otherwise(F.lit(0))
    slot = F.least(place, F.lit(bins - 1)).cast("int")
    low: Column = F.col("lo") + F.col("bin") * width
    return (
        values.select(slot.alias("bin"), "lo", "hi")
        .groupBy("bin", "lo", "hi")
        .agg(F.count("*").alias("count"))
        .select("bin", low.alias("low"), (low + width).alias("high"), "count")
    )


def top_frequencies(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """The k most frequent values of one column."""
    return (
        df.where(quoted(column).isNotNull())
        .groupBy(quoted(column).cast("string").alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "value")
        .limit(k)
    )
