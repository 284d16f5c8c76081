"""Filtering, projection, merging and SQL over loaded tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statloom.roles import quoted, roles

SOURCE_COLUMN = "__source__"

# Date formats tried in this order (fixed values).
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
    "yyyyMMdd",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
]


def filter_contains(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose value, as text, contains the case-insensitive regular expression."""
    return df.where(quoted(column).cast("string").rlike("(?i)" + str(pattern)))


def project_role(df: DataFrame, role: str) -> DataFrame:
    """The numeric, categorical or datetime columns."""
    return df.select(*[quoted(c) for c in getattr(roles(df), role)])


def select_columns(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The chosen columns that exist; ``None`` keeps all."""
    if columns is None:
        return df
    return df.select(*[quoted(c) for c in columns if c in df.columns])


def parse_date(column: Column) -> Column:
    """A timestamp from text in any of the known formats, null when none fits."""
    text = F.trim(column)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")


def as_timestamp(df: DataFrame, column: str) -> Column:
    if column in roles(df).categorical:
        return parse_date(quoted(column))
    return quoted(column).cast("timestamp_ntz")


def date_like_strings(df: DataFrame) -> DataFrame:
    """(column, date_like): do all present values of a text column parse as dates? One scan for all columns."""
    names = roles(df).categorical
    if not names:
        return df.sparkSession.createDataFrame([], "column string, date_like boolean")
    facts = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.bool_and(F.when(quoted(c).isNotNull(), parse_date(quoted(c)).isNotNull())), F.lit(False)).alias("date_like"),
        ).alias(f"d{i}")
        for i, c in enumerate(names)
    ]
    return df.agg(*facts).select(F.inline(F.array(*[F.col(f"d{i}") for i in range(len(names))])))


def date_columns(df: DataFrame) -> list[str]:
    """Datetime columns first, then text columns that hold dates."""
    likely = [r["column"] for r in date_like_strings(df).where("date_like").collect()]
    found = roles(df)
    return found.datetime + [c for c in found.categorical if c in likely]


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Listwise deletion; NaN counts as missing."""
    return df.dropna(subset=columns)


def merge_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Union by name with ``__source__`` first; a single table comes back unchanged."""
    if len(tables) == 1:
        return next(iter(tables.values()))
    tagged = [df.select(F.lit(name).alias(SOURCE_COLUMN), "*") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def view_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def run_query(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """SQL over the loaded tables; the result can feed any analysis."""
    for name, df in tables.items():
        df.createOrReplaceTempView(view_name(name))
    return spark.sql(sql)


def analysis_targets(tables: dict[str, DataFrame], mode: str = "merged") -> dict[str, DataFrame]:
    """Which tables an analysis runs on: merged, separate, or auto (merged, then each)."""
    if len(tables) == 1:
        return dict(tables)
    out: dict[str, DataFrame] = {}
    if mode in ("merged", "auto"):
        out["__merged__"] = merge_tables(tables)
    if mode in ("separate", "auto"):
        out.update(tables)
    return out


def aggregate_targets(merged: DataFrame, aggregates: list[Column], mode: str = "auto") -> DataFrame:
    """One pass for all targets of a merged table: a row per source and/or ``__merged__``."""
    if mode == "merged":
        return merged.agg(*aggregates).select(F.lit("__merged__").alias("target"), "*")
    if mode == "separate":
        return merged.groupBy(F.col(SOURCE_COLUMN).alias("target")).agg(*aggregates)
    grouped = merged.rollup(SOURCE_COLUMN).agg(*aggregates, F.grouping(SOURCE_COLUMN).alias("_all"))
    target = F.when(F.col("_all") == 1, "__merged__").otherwise(F.col(SOURCE_COLUMN))
    return grouped.select(target.alias("target"), *[c for c in grouped.columns if c not in (SOURCE_COLUMN, "_all")])


def compare_sources(merged: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, sum and mean of each column per source."""
    aggregates = [F.count("*").alias("rows")]
    for c in columns:
        aggregates += [F.sum(quoted(c)).alias(f"{c}_sum"), F.avg(quoted(c)).alias(f"{c}_mean")]
    return merged.groupBy(SOURCE_COLUMN).agg(*aggregates)


def random_rows(df: DataFrame, key: str, rows: int = 20, seed: int = 42) -> DataFrame:
    """A repeatable random sample: the rows with the smallest digest of the key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), quoted(key).cast("string"))), quoted(key)).limit(rows)


def head_rows(df: DataFrame, order: list[str], rows: int = 5) -> DataFrame:
    return df.orderBy(*[quoted(c) for c in order]).limit(rows)
