"""Data profile: per-column facts, frequent values, duplicates, quality score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statloom.operators.counts import column_quantiles, duplicate_count, top_values, value_counts
from statloom.roles import number, quoted, roles


def _role_of(df: DataFrame) -> dict[str, str]:
    found = roles(df)
    kind = {c: "numeric" for c in found.numeric + found.boolean}
    kind.update({c: "datetime" for c in found.datetime})
    return {c: kind.get(c, "categorical") for c in df.columns}


def _labelled(df: DataFrame, labels: dict[str, str], name: str) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return df.withColumn(name, F.element_at(pairs, F.col("column")))


def numeric_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, std, min, max) from one aggregation without a shuffle of rows."""
    aggregates = []
    for i, c in enumerate(columns):
        v = number(c)
        aggregates.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            ).alias(f"m{i}")
        )
    one = df.agg(*aggregates)
    return one.select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(columns))])))


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """A row per column: type, missing, missing_pct, unique, and for numbers mean/std/min/max/median.

    ``approximate`` swaps the distinct count for a sketch on very wide or long tables.
    """
    found = roles(df)
    moments = numeric_moments(df, found.numeric) if found.numeric else None
    if approximate:
        facts = []
        for i, c in enumerate(df.columns):
            facts.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.count_if(quoted(c).isNull()).alias("missing"),
                    F.count("*").alias("rows"),
                    F.approx_count_distinct(quoted(c)).alias("unique"),
                ).alias(f"f{i}")
            )
        base = df.agg(*facts).select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(df.columns))])))
    else:
        base = (
            value_counts(df)
            .groupBy("column")
            .agg(
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
                F.sum("n").alias("rows"),
                F.count("value").alias("unique"),
            )
        )
    out = _labelled(base, dict(df.dtypes), "dtype")
    out = _labelled(out, _role_of(df), "type")
    out = out.withColumn("missing_pct", F.round(F.col("missing") * 100.0 / F.col("rows"), 1)).drop("rows")
    if moments is None:
        for c in ("mean", "std", "min", "max", "median"):
            out = out.withColumn(c, F.lit(None).cast("double"))
        return out
    medians = column_quantiles(df, found.numeric, {"median": 0.5}).drop("_n")
    # Both sides hold one row per column of the table.
    return out.join(F.broadcast(moments.drop("count")), "column", "left").join(medians, "column", "left")


def profile_ranges(df: DataFrame) -> DataFrame:
    """(column, min, max) of the datetime columns as text."""
    columns = roles(df).datetime
    facts = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(quoted(c)).cast("string").alias("min"),
            F.max(quoted(c)).cast("string").alias("max"),
        ).alias(f"r{i}")
        for i, c in enumerate(columns)
    ]
    return df.agg(*facts).select(F.inline(F.array(*[F.col(f"r{i}") for i in range(len(columns))])))


def profile_top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of every categorical column."""
    kinds = _role_of(df)
    return top_values(value_counts(df, [c for c in df.columns if kinds[c] == "categorical"]), k)


def profile_summary(df: DataFrame) -> DataFrame:
    """One row of totals with the quality score.

    Grouping identical rows gives the duplicates, and summing missing cells over the groups gives
    the missing total, so the table is read once.
    """
    found = roles(df)
    cells = sum((quoted(c).isNull().cast("int") for c in df.columns), F.lit(0))
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cells = cells + F.coalesce(F.isnan(quoted(f.name)).cast("int"), F.lit(0))
    groups = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    totals = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(cells * F.col("_n")), F.lit(0)).alias("total_missing"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    width = len(df.columns)
    size = F.col("row_count") * F.lit(width)
    present = F.when(size > 0, (1 - F.col("total_missing") / size) * 100).otherwise(100.0)
    distinct = F.when(F.col("row_count") > 0, (1 - F.col("duplicate_rows") / F.col("row_count")) * 100).otherwise(100.0)
    score = F.round(present * 0.7 + distinct * 0.3, 1)
    return totals.select(
        "row_count",
        F.lit(width).cast("long").alias("col_count"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("quality_score"),
        "total_missing",
        F.when(size > 0, F.round(F.col("total_missing") * 100.0 / size, 1)).otherwise(0.0).alias("total_missing_pct"),
        "duplicate_rows",
        F.lit(len(found.numeric)).cast("long").alias("numeric_columns"),
        F.lit(len(found.categorical)).cast("long").alias("categorical_columns"),
    )


def profile_report(df: DataFrame) -> dict[str, DataFrame]:
    """All profile tables, for the result sink."""
    report = {"profile_summary": profile_summary(df), "profile_columns": profile_columns(df)}
    if any(k == "categorical" for k in _role_of(df).values()):
        report["profile_top_values"] = profile_top_values(df)
    if roles(df).datetime:
        report["profile_ranges"] = profile_ranges(df)
    return report


__all__ = [
    "duplicate_count",
    "numeric_moments",
    "profile_columns",
    "profile_ranges",
    "profile_report",
    "profile_summary",
    "profile_top_values",
]
