"""Pareto (80/20) and cohort retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statloom.functions.ordered import prefix_sum
from statloom.operators.relational import as_timestamp, date_columns
from statloom.roles import number, quoted

SHARE = 80.0


def pareto(df: DataFrame, category: str, value: str) -> DataFrame:
    """(label, value, pct, cumulative_pct, in_80) per category, largest first.

    An item belongs to the 80 % group while the items before it stay below 80 %.
    """
    sums = (
        df.select(quoted(category).cast("string").alias("label"), number(value).alias("v"))
        .where("label is not null")
        .groupBy("label")
        .agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("value"))
    )
    run = prefix_sum(sums, ["value", "label"], {"_run": "value"}, [], {"_all": "value"}, descending_first=True)
    # a total of zero has no shares: they are null, and no item is in the 80 % group
    share = lambda c: F.try_divide(c, F.col("_all")) * 100
    before = share(F.col("_run") - F.col("value"))
    return run.select(
        "label",
        "value",
        share(F.col("value")).alias("pct"),
        share(F.col("_run")).alias("cumulative_pct"),
        F.coalesce(before < SHARE, F.lit(False)).alias("in_80"),
    )


def pareto_summary(table: DataFrame) -> DataFrame:
    top = F.max(F.struct("value", "label"))
    return table.agg(
        F.count("*").alias("total_categories"),
        F.count_if("in_80").alias("items_80_pct"),
        top["label"].alias("top_category"),
        top["value"].alias("top_value"),
    )


def pareto_top(table: DataFrame, k: int = 10) -> DataFrame:
    return table.orderBy(F.desc("value"), "label").limit(k)


def cohort_user_column(df: DataFrame, dates: list[str]) -> str | None:
    """First non-date column with more than one distinct value (min differs from max)."""
    columns = [c for c in df.columns if c not in dates]
    if not columns:
        return None
    row = df.agg(
        *[(F.min(quoted(c)) < F.max(quoted(c))).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    return next((c for i, c in enumerate(columns) if row[i]), None)


def cohort(df: DataFrame, user: str, date: str) -> DataFrame:
    """(cohort, period, users, cohort_size, retention_pct) over the full cohort × period grid.

    The cohort is the month of the user's first activity. A user's months fit one small set, so one
    shuffle on the user with map-side folding is enough, however active a user is.
    """
    ts = as_timestamp(df, date)
    month = F.year(ts) * 12 + F.month(ts) - 1
    months = (
        df.select(quoted(user).alias("u"), month.alias("m"))
        .where("u is not null and m is not null")
        .groupBy("u")
        .agg(F.collect_set("m").alias("ms"))
    )
    cells = (
        months.select(F.array_min("ms").alias("c"), F.explode("ms").alias("m"))
        .groupBy("c", (F.col("m") - F.col("c")).alias("period"))
        .agg(F.count("*").alias("users"))
    )
    # Grid: every period seen in any cohort. Cells are bounded by the months squared.
    last = cells.agg(F.array_sort(F.collect_set("period")).alias("p"))
    sizes = cells.where("period = 0").select("c", F.col("users").alias("cohort_size"))
    grid = sizes.withColumn("period", F.explode(last.scalar()))
    label = F.format_string("%04d-%02d", F.floor(F.col("c") / 12).cast("int"), (F.col("c") % 12 + 1).cast("int"))
    users = F.coalesce("users", F.lit(0))
    return grid.join(cells, ["c", "period"], "left").select(
        label.alias("cohort"),
        "period",
        users.alias("users"),
        "cohort_size",
        (users / F.col("cohort_size") * 100).alias("retention_pct"),
    )


def cohort_columns(df: DataFrame, params: dict) -> tuple[str, str]:
    """User and date column from the parameters or by rule."""
    dates = date_columns(df)
    date = params.get("date_column") or (dates[0] if dates else None)
    user = params.get("group_column") or cohort_user_column(df, dates)
    if not date or not user:
        raise ValueError("cohort needs a user column and a date column")
    return user, date
