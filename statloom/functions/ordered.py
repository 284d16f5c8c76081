"""Global-order primitives that never sort a table in one task.

Ranks, running sums, exact quantiles and lags all need a total order. The order is cut into value
ranges whose bounds come from a hash-chosen sample; the bounds only balance the work, results do
not depend on them. Inside a range a window computes local sums, and per-range totals (one row per
key and range) give the offsets. A bound is a pure function of the data, so a recomputed task puts
a row into the same range. Inputs of every size take this one path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from statloom.session import bucket_count

ROWS_PER_BOUND = 24


def order_bounds(df: DataFrame, order: list[Column], columns: list[str], buckets: int) -> DataFrame:
    """One row holding ``buckets - 1`` splitting keys of the given order."""
    sample = (
        df.select(F.struct(*order).alias("_key"), F.xxhash64(*columns).alias("_h"))
        .orderBy("_h", "_key")
        .limit(buckets * ROWS_PER_BOUND)
        .agg(F.array_sort(F.collect_list("_key")).alias("_keys"))
    )
    picks = F.transform(
        F.sequence(F.lit(1), F.lit(buckets - 1)),
        lambda i: F.get("_keys", (i * F.size("_keys") / F.lit(buckets)).cast("int")),
    )
    return sample.select(picks.alias("_bounds"))


def range_bucket(bounds: Column, key: Column, buckets: int) -> Column:
    """Number of bounds not above the key; a coarse then a fine look-up for many bounds."""
    if buckets <= 64:
        return F.size(F.filter(bounds, lambda b: b <= key))
    step = int(buckets**0.5)
    coarse = F.size(F.filter(bounds, lambda b, i: (i % step == step - 1) & (b <= key)))
    start = coarse * step
    fine = F.size(F.filter(F.slice(bounds, start + 1, F.lit(step)), lambda b: b <= key))
    return start + fine


def prefix_sum(
    df: DataFrame,
    order: list[str],
    sums: dict[str, str],
    keys: list[str] | None = None,
    totals: dict[str, str] | None = None,
    descending_first: bool = False,
) -> DataFrame:
    """Add inclusive running sums ``sums[out] = column`` and totals ``totals[out] = column``.

    ``df`` should hold one row per (keys, order), that is be aggregated first. With
    ``descending_first`` the first (numeric) order column runs downwards.
    """
    keys = keys or []
    totals = totals or {}
    first = -F.col(order[0]) if descending_first else F.col(order[0])
    sort = [first] + [F.col(c) for c in order[1:]]
    buckets = bucket_count(df.sparkSession)
    order_key = [first.alias("_o0")] + [F.col(c).alias(f"_o{i}") for i, c in enumerate(order[1:], 1)]
    bounds = order_bounds(df, order_key, df.columns, buckets)
    placed = (
        df.withColumn("_bounds", bounds.scalar())
        .withColumn("_range", range_bucket(F.col("_bounds"), F.struct(*order_key), buckets))
        .drop("_bounds")
    )
    within = Window.partitionBy(*keys, "_range").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    measured = sorted(set(sums.values()) | set(totals.values()))
    per_range = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in measured])
    # At most one row per key and range reaches these windows.
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_range.select(
        *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)],
        F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in set(sums.values())],
        *[F.sum(f"_t_{c}").over(whole).alias(out) for out, c in totals.items()],
    )
    local = placed.select("*", *[F.sum(c).over(within).alias(f"_run_{o}") for o, c in sums.items()])
    # null-safe, or the optimiser infers a filter on the totals from the expression behind _range
    match = F.col("_range").eqNullSafe(F.col("_r"))
    for i, k in enumerate(keys):
        match = match & (F.col(k) == F.col(f"_k_{i}"))
    joined = local.join(offsets, match)
    return joined.select(
        *df.columns,
        *[(F.col(f"_run_{o}") + F.col(f"_off_{c}")).alias(o) for o, c in sums.items()],
        *totals.keys(),
    )


def weighted_quantiles(
    counts: DataFrame, value: str, probabilities: dict[str, float], keys: list[str] | None = None, weight: str = "n"
) -> DataFrame:
    """Exact, linearly interpolated quantiles of a table of (keys, value, weight) rows.

    One row per key: the named quantiles plus the total weight as ``_n``. The work is a prefix sum
    over distinct values, so no group is ever held in one task's memory.
    """
    keys = keys or []
    ranked = prefix_sum(counts.select(*keys, value, weight), [value], {"_upto": weight}, keys, {"_n": weight})
    aggregates: list[Column] = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col(weight))
            aggregates.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
    grouped = ranked.groupBy(*keys).agg(*aggregates, F.max("_n").alias("_n"))
    out: list[Column] = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return grouped.select(*keys, *out, "_n")


def positions(df: DataFrame, order: list[str], name: str = "_pos") -> DataFrame:
    """1-based position of every row in the order; rows must be unique in it."""
    return prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}).drop("_one")


def lagged(df: DataFrame, order: list[str], columns: list[str], lags: int, keep: list[str] | None = None) -> DataFrame:
    """Every row with its ``lags`` predecessors: ``c`` as ``c_l0`` and ``c_l1 .. c_lk``.

    Instead of a one-partition window each row is sent to the positions it is a lag of, and one
    shuffle on the position brings a row and its lags together.
    """
    keep = keep or []
    placed = positions(df.select(*dict.fromkeys([*order, *keep, *columns])), order)
    sent = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("_lag")).withColumn(
        "_at", F.col("_pos") + F.col("_lag")
    )
    aggregates = [F.max(F.when(F.col("_lag") == 0, F.col(c))).alias(c) for c in dict.fromkeys([*order, *keep])]
    aggregates += [
        F.max(F.when(F.col("_lag") == j, F.col(c))).alias(f"{c}_l{j}") for c in columns for j in range(lags + 1)
    ]
    wide = sent.groupBy("_at").agg(*aggregates, F.max(F.when(F.col("_lag") == 0, 1)).alias("_own"))
    return wide.where("_own = 1").drop("_own").withColumnRenamed("_at", "_pos")
