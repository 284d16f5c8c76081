"""Distinct values with their counts: the shared base of profiles, cleaning and frequencies.

One shuffle over distinct (column, value) pairs yields missing and distinct counts, frequent values,
modes and medians. Map-side combine folds a repeated value before the shuffle, so one value that
fills a third of a column costs one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from statloom.functions.ordered import prefix_sum, weighted_quantiles
from statloom.roles import quoted, roles
from statloom.session import cut_lineage

DOUBLE_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)


def _typed_groups(df: DataFrame, columns: list[str]) -> list[tuple[str, list[str]]]:
    """Columns by the type in which their values can be compared without loss."""
    groups: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if f.name not in columns:
            continue
        if isinstance(f.dataType, DOUBLE_TYPES):
            kind = "double"
        elif isinstance(f.dataType, T.LongType):
            kind = "long"
        elif isinstance(f.dataType, T.DecimalType):
            kind = "decimal(38,10)"
        else:
            kind = "string"
        groups.setdefault(kind, []).append(f.name)
    return list(groups.items())


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, number, n): a row per distinct value, null included.

    ``value`` is the text form; ``number`` the double of a numeric column.
    """
    columns = columns if columns is not None else df.columns
    numeric = set(roles(df).numeric)
    parts = []
    for kind, names in _typed_groups(df, columns):
        typed = []
        for name in names:
            c = quoted(name).cast(kind)
            if kind == "double":
                c = F.when(~F.isnan(c), c + F.lit(0.0))
            typed.append(c.alias(name))
        long = df.select(*typed).unpivot([], [quoted(n) for n in names], "column", "v")
        counted = long.groupBy("column", "v").agg(F.count("*").alias("n"))
        is_number = F.col("column").isin([n for n in names if n in numeric])
        as_double = F.col("v").cast("double") if kind != "string" else F.lit(None).cast("double")
        parts.append(
            counted.select(
                "column",
                F.col("v").cast("string").alias("value"),
                F.when(is_number, as_double).alias("number"),
                "n",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def number_counts(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, column, number, n) over the present values of numeric columns."""
    keys = keys or []
    chosen = [quoted(k) for k in keys]
    for name in columns:
        c = quoted(name).cast("double")
        chosen.append(F.when(~F.isnan(c), c + F.lit(0.0)).alias(name))
    long = df.select(*chosen).unpivot([quoted(k) for k in keys], [quoted(c) for c in columns], "column", "number")
    return long.where("number is not null").groupBy(*keys, "column", "number").agg(F.count("*").alias("n"))


#: Relative rank error of the sketch that brackets each quantile (1 / accuracy of percentile_approx).
SKETCH_ACCURACY = 10_000


def column_quantiles(df: DataFrame, columns: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of many columns, a row per column, present rows as ``_n``.

    Brackets: a mergeable sketch (``percentile_approx``, combined map-side) gives for each quantile
    values a little below and above it; a second pass counts the rows below the bracket and
    shuffles only the rows inside it, whose running counts place the exact ranks. Should a bracket
    miss its rank (the sketch's bound makes that rare), that column is answered by the running
    counts of all its distinct values instead.
    """
    chosen = []
    for name in columns:
        c = quoted(name).cast("double")
        chosen.append(F.when(~F.isnan(c), c + F.lit(0.0)).alias(name))
    long = df.select(*chosen).unpivot([], [quoted(c) for c in columns], "column", "number").where("number is not null")
    eps = 1.0 / SKETCH_ACCURACY
    names = list(probabilities)
    marks = [max(0.0, probabilities[q] - 3 * eps) for q in names] + [min(1.0, probabilities[q] + 3 * eps) for q in names]
    sketch = long.groupBy("column").agg(
        F.count("*").alias("_n"), F.percentile_approx("number", marks, SKETCH_ACCURACY).alias("_marks")
    )
    brackets = sketch.select(
        "column", "_n",
        F.inline(F.array(*[
            F.struct(F.lit(q).alias("q"), F.col("_marks")[i].alias("lo"), F.col("_marks")[i + len(names)].alias("hi"))
            for i, q in enumerate(names)
        ])),
    )
    met = long.join(F.broadcast(brackets), "column")
    below = met.groupBy("column", "q").agg(F.count(F.when(F.col("number") < F.col("lo"), 1)).alias("_below"))
    inside = (
        met.where((F.col("number") >= F.col("lo")) & (F.col("number") <= F.col("hi")))
        .groupBy("column", "q", "number")
        .agg(F.count("*").alias("n"))
    )
    ranked = prefix_sum(inside, ["number"], {"_upto": "n"}, ["column", "q"]).join(below, ["column", "q"])
    ranked = ranked.join(F.broadcast(brackets.select("column", "q", "_n")), ["column", "q"])
    share = F.element_at(F.map_from_arrays(F.array(*[F.lit(q) for q in names]), F.array(*[F.lit(float(probabilities[q])) for q in names])), F.col("q"))
    position = share * (F.col("_n") - 1)
    upto = F.col("_upto") + F.col("_below")
    found = []
    for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
        hit = (rank < upto) & (rank >= upto - F.col("n"))
        found.append(F.max(F.when(hit, F.col("number"))).alias(f"_{side}"))
    picked = ranked.groupBy("column", "q").agg(*found, F.max("_n").alias("_n"), F.first(position).alias("_pos"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor(F.col("_pos")))
    wide = cut_lineage(picked.groupBy("column").agg(
        *[F.max(F.when(F.col("q") == q, value)).alias(q) for q in names],
        *[F.max(F.when(F.col("q") == q, F.col("_lo").isNotNull() & F.col("_hi").isNotNull())).alias(f"_ok_{q}") for q in names],
        F.max("_n").alias("_n"),
    ))
    whole = F.lit(True)
    for q in names:
        whole = whole & F.coalesce(F.col(f"_ok_{q}"), F.lit(False))
    good = wide.where(whole).select("column", *names, "_n")
    missed = wide.where(~whole).select("column")
    if missed.isEmpty():
        return good
    rest = weighted_quantiles(number_counts(df, columns).join(missed, "column"), "number", probabilities, ["column"])
    return good.unionByName(rest)


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent present values per column, ties by value.

    The row_number filter becomes a per-task top-k before the shuffle.
    """
    rank = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        counts.where("value is not null")
        .select("column", "value", "n", F.row_number().over(rank).alias("rank"))
        .where(F.col("rank") <= k)
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of every identical row (nulls equal)."""
    groups = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )
