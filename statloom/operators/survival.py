"""Kaplan–Meier curves and the log-rank test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statloom.functions.ordered import prefix_sum
from statloom.functions.special import chi2_upper
from statloom.roles import number, quoted, roles

Z_95 = 1.959963984540054


def survival_columns(df: DataFrame, params: dict) -> tuple[str, str]:
    """Duration: first numeric column, never negative, with more than two values. Event: first other 0/1 column."""
    numeric = roles(df).numeric
    facts = []
    for c in numeric:
        v = number(c)
        many = F.count_distinct(v) > 2
        facts += [(many & (F.min(v) >= 0)), F.coalesce(F.bool_and(v.isin(0.0, 1.0)), F.lit(True))]
    row = df.agg(*[f.alias(f"f{i}") for i, f in enumerate(facts)]).first() if facts else []
    duration = params.get("target_column") or next((c for i, c in enumerate(numeric) if row[2 * i]), None)
    event = next((c for i, c in enumerate(numeric) if c != duration and row[2 * i + 1]), None)
    if not duration or not event:
        raise ValueError("survival needs a duration column and a 0/1 event column")
    return duration, event


def _deaths(df: DataFrame, duration: str, event: str) -> DataFrame:
    rows = df.select(number(duration).alias("time"), quoted(event).cast("int").alias("e"))
    return (
        rows.where("time is not null and e is not null")
        .groupBy("time")
        .agg(F.count("*").alias("n"), F.sum("e").cast("long").alias("events"))
    )


def kaplan_meier(df: DataFrame, duration: str, event: str) -> DataFrame:
    """(time, at_risk, events, censored, survival, ci_low, ci_high) with the log-log Greenwood band.

    Work is on distinct times; both running sums are distributed prefix sums.
    """
    counted = prefix_sum(_deaths(df, duration, event), ["time"], {"_upto": "n"}, [], {"_all": "n"})
    risk = F.col("_all") - F.col("_upto") + F.col("n")
    d, r = F.col("events"), F.col("at_risk").cast("double")
    terms = counted.select("time", risk.alias("at_risk"), "events", (F.col("n") - F.col("events")).alias("censored"))
    terms = terms.select(
        "*",
        F.when(d < r, F.log1p(-d / r)).otherwise(0.0).alias("_log"),
        F.when(d < r, d / (r * (r - d))).otherwise(0.0).alias("_var"),
        (d >= r).cast("long").alias("_end"),
    )
    run = prefix_sum(terms, ["time"], {"_ls": "_log", "_g": "_var", "_dead": "_end"})
    s = F.when(F.col("_dead") > 0, 0.0).otherwise(F.exp("_ls"))
    inner = (s > 0) & (s < 1)
    reach = Z_95 * F.sqrt("_g") / F.col("_ls")
    low = F.when(inner, F.exp(-F.exp(F.ln(-F.col("_ls")) - reach))).otherwise(s)
    high = F.when(inner, F.exp(-F.exp(F.ln(-F.col("_ls")) + reach))).otherwise(s)
    return run.select(
        "time",
        "at_risk",
        "events",
        "censored",
        s.alias("survival"),
        F.least(low, high).alias("ci_low"),
        F.greatest(low, high).alias("ci_high"),
    )


def survival_summary(curve: DataFrame) -> DataFrame:
    """Median survival (null when not reached), events, observations."""
    return curve.agg(
        F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_survival"),
        F.sum("events").alias("events"),
        F.sum(F.col("events") + F.col("censored")).alias("observations"),
    )


def log_rank(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """(group, observed, expected) rows plus the chi-square and p on every row.

    Groups become columns, so their number is bounded by Spark's pivot limit; times stay distributed.
    """
    import numpy as np

    spark = df.sparkSession
    rows = df.select(
        number(duration).alias("time"),
        quoted(event).cast("int").alias("e"),
        quoted(group).cast("string").alias("g"),
    ).where("time is not null and e is not null and g is not null")
    limit = int(spark.conf.get("spark.sql.pivotMaxValues"))
    names = [r["g"] for r in rows.select("g").distinct().orderBy("g").limit(limit + 1).collect()]
    if len(names) > limit or len(names) < 2:
        raise ValueError("log-rank needs between 2 groups and the pivot limit")
    k = len(names)
    counts = rows.groupBy("time").agg(
        F.count("*").alias("n"),
        F.sum("e").alias("d"),
        *[F.count_if(F.col("g") == n).alias(f"n{i}") for i, n in enumerate(names)],
        *[F.sum(F.when(F.col("g") == n, F.col("e")).otherwise(0)).alias(f"d{i}") for i, n in enumerate(names)],
    )
    measured = ["n", *[f"n{i}" for i in range(k)]]
    run = prefix_sum(
        counts, ["time"], {f"_u{c}": c for c in measured}, [], {f"_t{c}": c for c in measured}
    )

    def risk(c: str) -> Column:
        return (F.col(f"_t{c}") - F.col(f"_u{c}") + F.col(c)).cast("double")

    n, d = risk("n"), F.col("d").cast("double")
    weight = F.when(n > 1, d * (n - d) / (n - 1) / (n * n)).otherwise(0.0)
    aggregates = []
    for i in range(k):
        aggregates.append(F.sum(f"d{i}").cast("double").alias(f"o{i}"))
        aggregates.append(F.sum(d * risk(f"n{i}") / n).alias(f"x{i}"))
        for j in range(i, k):
            own = n * risk(f"n{i}") if i == j else F.lit(0.0)
            aggregates.append(F.sum(weight * (own - risk(f"n{i}") * risk(f"n{j}"))).alias(f"v{i}_{j}"))
    r = run.agg(*aggregates).first()
    gap = np.array([r[f"o{i}"] - r[f"x{i}"] for i in range(k)])
    cov = np.array([[r[f"v{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    chi2 = float(gap[:-1] @ np.linalg.pinv(cov[:-1, :-1]) @ gap[:-1])
    out = spark.createDataFrame(
        [(names[i], r[f"o{i}"], r[f"x{i}"], chi2, k - 1) for i in range(k)],
        "group string, observed double, expected double, chi2 double, dof int",
    )
    return out.withColumn("p_value", chi2_upper(F.col("chi2"), F.col("dof")))
