"""Hypothesis tests from grouped moments and grouped counts.

Rows are folded map-side to one moment row per group, or one count row per distinct value, before
anything is shuffled; p-values are Columns on the few rows that remain. "First" group means the
smallest group value, since a distributed table has no order of appearance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from statloom.functions.ordered import prefix_sum, weighted_quantiles
from statloom.functions.special import chi2_upper, f_upper, normal_two_sided, studentized_range_upper, t_quantile, t_two_sided
from statloom.roles import number, quoted, roles

ALPHA = 0.05
# Up to this size of the smaller group the exact law of the rank test is meant to be used (fixed value).
EXACT_GROUP = 8


def distinct_counts(df: DataFrame, columns: list[str]) -> tuple[dict[str, int], int]:
    """Distinct values per column and the row count. A sketch in one pass ranks columns; small counts it gives exactly."""
    if not columns:
        return {}, 0
    facts = [F.approx_count_distinct(quoted(c), 0.01).alias(f"d{i}") for i, c in enumerate(columns)]
    row = df.agg(*facts, F.count("*").alias("rows")).first()
    return {c: row[i] for i, c in enumerate(columns)}, row["rows"]


def pick_group(df: DataFrame, levels: int, at_least: bool = False) -> str | None:
    """First categorical column with the wanted number of levels; never one with a value of its own in most rows."""
    columns = roles(df).categorical
    counts, rows = distinct_counts(df, columns)
    columns = [c for c in columns if 2 * counts[c] <= rows]
    for c in columns:
        if counts[c] == levels or (at_least and counts[c] >= levels):
            return c
    return None if at_least else next((c for c in columns if 1 < counts[c] < rows), None)


def group_moments(df: DataFrame, target: str, group: str) -> DataFrame:
    """(grp, n, mean, var) per present group."""
    return (
        df.select(quoted(group).alias("grp"), number(target).alias("v"))
        .where("grp is not null and v is not null")
        .groupBy("grp")
        .agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    )


def _pooled(n1: Column, v1: Column, n2: Column, v2: Column) -> Column:
    spare = lambda n, v: F.when(n > 1, (n - 1) * v).otherwise(0.0)
    return F.try_divide(spare(n1, v1) + spare(n2, v2), n1 + n2 - 2)


def ttest(df: DataFrame, target: str, group: str) -> DataFrame:
    """Student's t with pooled variance, two-sided p, Cohen's d and the 95 % interval of the difference."""
    two = group_moments(df, target, group).orderBy("grp").limit(2)
    both = two.agg(
        F.min(F.struct("grp", "n", "mean", "var")).alias("a"),
        F.max(F.struct("grp", "n", "mean", "var")).alias("b"),
    ).where("a.grp <> b.grp")
    c = {f"{x}{i}": F.col(f"{s}.{x}") for i, s in ((1, "a"), (2, "b")) for x in ("grp", "n", "mean", "var")}
    dof = c["n1"] + c["n2"] - 2
    error = F.sqrt(_pooled(c["n1"], c["var1"], c["n2"], c["var2"]) * (1.0 / c["n1"] + 1.0 / c["n2"]))
    spread = F.sqrt((c["var1"] + c["var2"]) / 2)
    base = both.select(
        c["grp1"].cast("string").alias("group1"),
        c["grp2"].cast("string").alias("group2"),
        c["n1"].alias("n1"),
        c["n2"].alias("n2"),
        c["mean1"].alias("mean1"),
        c["mean2"].alias("mean2"),
        (c["mean1"] - c["mean2"]).alias("difference"),
        error.alias("std_error"),
        dof.alias("dof"),
        F.try_divide(c["mean1"] - c["mean2"], F.nullif(error, F.lit(0.0))).alias("t_stat"),
        F.when(spread > 0, (c["mean1"] - c["mean2"]) / spread).otherwise(0.0).alias("cohens_d"),
    )
    scored = base.withColumn("p_value", t_two_sided(F.col("t_stat"), F.col("dof")))
    margin = F.col("_t") * F.col("std_error")
    return (
        scored.withColumn("_t", t_quantile(ALPHA, F.col("dof").cast("double")))
        .withColumn("ci_low", F.col("difference") - margin)
        .withColumn("ci_high", F.col("difference") + margin)
        .withColumn("significant", F.col("p_value") < ALPHA)
        .drop("_t")
    )


def f_table(moments: DataFrame, grand_mean: Column | None = None) -> DataFrame:
    """One-way F from (grp, n, mean, var) rows; eta squared is taken about ``grand_mean``."""
    totals = moments.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"))
    tagged = moments.withColumn("_t", totals.select(F.struct("n", "m")).scalar())
    about = F.col("_t.m") if grand_mean is None else grand_mean
    tagged = tagged.withColumn("_g", about)
    sums = tagged.agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_t.m")) ** 2).alias("ss_between"),
        F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0.0)).alias("ss_within"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_g")) ** 2).alias("_about"),
    )
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.when(
        (F.col("ss_within") > 0) & (d1 > 0), F.try_divide(F.try_divide(F.col("ss_between"), d1), F.try_divide(F.col("ss_within"), d2))
    )
    total = F.col("_about") + F.col("ss_within")
    out = sums.select(
        "groups",
        "n",
        "ss_between",
        "ss_within",
        f.alias("f_stat"),
        F.when(total > 0, F.col("_about") / total).otherwise(0.0).alias("eta_squared"),
    )
    return out.withColumn(
        "p_value", f_upper(F.col("f_stat"), F.col("groups") - 1, F.col("n") - F.col("groups"))
    ).withColumn("significant", F.col("p_value") < ALPHA)


def anova(df: DataFrame, target: str, group: str) -> DataFrame:
    grand = df.select(F.avg(number(target)).alias("g"))
    return f_table(group_moments(df, target, group), grand.scalar())


def pairwise_comparison(df: DataFrame, target: str, group: str) -> DataFrame:
    """Every pair of groups: mean difference, pooled t, Bonferroni-adjusted p.

    The inputs are one row per group; the pairs are the requested output.
    """
    m = group_moments(df, target, group)
    counted = m.withColumn("_k", m.agg(F.count("*").alias("k")).scalar())
    a = counted.select(*[F.col(c).alias(f"{c}1") for c in m.columns], "_k")
    b = m.select(*[F.col(c).alias(f"{c}2") for c in m.columns])
    pairs = a.join(b, F.col("grp1") < F.col("grp2"))
    dof = F.col("n1") + F.col("n2") - 2
    error = F.sqrt(
        _pooled(F.col("n1"), F.col("var1"), F.col("n2"), F.col("var2")) * (1.0 / F.col("n1") + 1.0 / F.col("n2"))
    )
    out = pairs.select(
        F.col("grp1").alias("group1"),
        F.col("grp2").alias("group2"),
        (F.col("mean1") - F.col("mean2")).alias("difference"),
        F.try_divide(F.col("mean1") - F.col("mean2"), F.nullif(error, F.lit(0.0))).alias("t_stat"),
        dof.alias("dof"),
        (F.col("_k") * (F.col("_k") - 1) / 2).alias("_m"),
    )
    p = F.least(F.lit(1.0), t_two_sided(F.col("t_stat"), F.col("dof")) * F.col("_m"))
    return (
        out.withColumn("p_adjusted", p)
        .withColumn("method", F.lit("bonferroni"))
        .withColumn("significant", F.col("p_adjusted") < ALPHA)
        .drop("_m")
    )


def tukey_hsd(df: DataFrame, target: str, group: str) -> DataFrame:
    """Tukey–Kramer: every pair of groups with the mean difference, q = |difference| / √(MSE/2 ·
    (1/n₁ + 1/n₂)) over the error mean square of all groups, and p from the studentised range law
    of k groups with N − k degrees of freedom.

    The rows are folded to one moment row per group first; the pairs are the requested output.
    """
    m = group_moments(df, target, group)
    total = m.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n_all"),
        F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0.0)).alias("ss"),
    )
    a = m.select(*[F.col(c).alias(f"{c}1") for c in m.columns])
    b = m.select(*[F.col(c).alias(f"{c}2") for c in m.columns])
    pairs = a.join(b, F.col("grp1") < F.col("grp2")).select(
        "*",
        total.select("k").scalar().alias("k"),
        total.select(F.col("n_all") - F.col("k")).scalar().alias("dof"),
        total.select(F.try_divide(F.col("ss"), F.col("n_all") - F.col("k"))).scalar().alias("mse"),
    )
    scale = F.sqrt(F.col("mse") / 2 * (1.0 / F.col("n1") + 1.0 / F.col("n2")))
    q = F.try_divide(F.abs(F.col("mean1") - F.col("mean2")), F.nullif(scale, F.lit(0.0)))
    out = pairs.select(
        F.col("grp1").alias("group1"),
        F.col("grp2").alias("group2"),
        (F.col("mean1") - F.col("mean2")).alias("difference"),
        q.alias("q_stat"),
        F.col("dof"),
        studentized_range_upper(q, F.col("k"), F.col("dof")).alias("p_adjusted"),
    )
    return out.withColumn("method", F.lit("tukey")).withColumn("significant", F.col("p_adjusted") < ALPHA)


def contingency(df: DataFrame, first: str, second: str) -> DataFrame:
    """(row, col, count) of the observed cells."""
    return (
        df.select(quoted(first).cast("string").alias("row"), quoted(second).cast("string").alias("col"))
        .where("row is not null and col is not null")
        .groupBy("row", "col")
        .agg(F.count("*").alias("count"))
    )


def contingency_grid(df: DataFrame, first: str, second: str) -> DataFrame:
    """The full grid with zeros, through a pivot. Beyond Spark's pivot limit of column values (a
    key-like column) the grid is the observed cells alone, so the analysis never fails on width."""
    observed = contingency(df, first, second)
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    if observed.select("col").distinct().limit(limit + 1).count() > limit:
        return observed
    wide = observed.groupBy("row").pivot("col").agg(F.sum("count"))
    columns = [c for c in wide.columns if c != "row"]
    long = wide.na.fill(0).unpivot(["row"], [quoted(c) for c in columns], "col", "count")
    return long


def chi_square(df: DataFrame, first: str, second: str) -> DataFrame:
    """Chi-square of independence with Yates' correction when dof is 1; Cramér's V.

    Empty cells need no rows: the sum over all cells of (O-E)²/E is the sum of O²/E minus N.
    """
    cells = contingency(df, first, second)
    rows = cells.groupBy(F.col("row").alias("_r")).agg(F.sum("count").alias("row_n"))
    cols = cells.groupBy(F.col("col").alias("_c")).agg(F.sum("count").alias("col_n"))
    row_facts = rows.agg(
        F.count("*").alias("r"), F.sum(1.0 / F.col("row_n")).alias("inv"), F.sum("row_n").alias("n")
    ).select(F.struct("r", "inv", "n"))
    col_facts = cols.agg(F.count("*").alias("c"), F.sum(1.0 / F.col("col_n")).alias("inv")).select(
        F.struct("c", "inv")
    )
    joined = cells.join(rows, F.col("row") == F.col("_r")).join(cols, F.col("col") == F.col("_c"))
    joined = joined.withColumn("_rf", row_facts.scalar())
    expected = F.col("row_n") * F.col("col_n") / F.col("_rf.n").cast("double")
    sums = (
        joined.withColumn("e", expected)
        .agg(
            F.sum(F.col("count") ** 2 / F.col("e")).alias("_ratio"),
            F.max(F.abs(F.col("count") - F.col("e"))).alias("_gap"),
            F.max("_rf").alias("_rf"),
        )
        .withColumn("_cf", col_facts.scalar())
    )
    n = F.col("_rf.n").cast("double")
    dof = (F.col("_rf.r") - 1) * (F.col("_cf.c") - 1)
    corrected = F.greatest(F.col("_gap") - 0.5, F.lit(0.0)) ** 2 * n * F.col("_rf.inv") * F.col("_cf.inv")
    smaller = F.least(F.col("_rf.r"), F.col("_cf.c")) - 1
    base = sums.select(
        F.when(dof == 1, corrected).otherwise(F.greatest(F.col("_ratio") - n, F.lit(0.0))).alias("chi2"),
        dof.alias("dof"),
        F.col("_rf.n").alias("n"),
        smaller.alias("_s"),
    )
    return (
        base.withColumn(
            "cramers_v",
            F.when(F.col("n") * F.col("_s") > 0, F.sqrt(F.col("chi2") / (F.col("n") * F.col("_s")))).otherwise(0.0),
        )
        .withColumn("p_value", F.when(F.col("dof") > 0, chi2_upper(F.col("chi2"), F.col("dof"))).otherwise(1.0))
        .withColumn("significant", F.col("p_value") < ALPHA)
        .drop("_s")
    )


def _exact_p(u_max: float, n1: int, n2: int) -> float:
    """P by the exact law of U: coefficients of the Gaussian binomial (n1 + n2 over n1)."""
    small, large = min(n1, n2), max(n1, n2)
    size = small * large
    ways = np.zeros(size + 1)
    ways[0] = 1.0
    for i in range(1, small + 1):
        top = large + i
        for j in range(size, top - 1, -1):
            ways[j] -= ways[j - top]
        for j in range(i, size + 1):
            ways[j] += ways[j - i]
    tail = ways[int(np.ceil(u_max)) :].sum() / ways.sum()
    return min(1.0, 2 * tail)


@F.pandas_udf(T.DoubleType())
def _exact_u(u: pd.Series, n1: pd.Series, n2: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series(
        [_exact_p(a, int(b), int(c)) if w else None for a, b, c, w in zip(u, n1, n2, wanted)], dtype="float64"
    )


def mann_whitney(df: DataFrame, target: str, group: str, method: str = "auto") -> DataFrame:
    """U of the first group, two-sided p, rank-biserial correlation and both medians.

    ``method`` is the law of U: normal, exact (time grows with the product of the sizes squared), or auto,
    which takes the exact law without ties when a group has at most EXACT_GROUP rows.

    Only distinct values with a count per group are ordered; the rank sum follows from the running
    count of values below.
    """
    rows = df.select(quoted(group).alias("grp"), number(target).alias("v")).where(
        "grp is not null and v is not null"
    )
    # As in a group-by on the column: a group counts even if it is later found empty.
    names = (
        df.select(quoted(group).alias("g"))
        .where("g is not null")
        .distinct()
        .orderBy("g")
        .limit(2)
        .agg(F.struct(F.min("g").alias("a"), F.max("g").alias("b")).alias("s"))
    )
    counts = rows.groupBy("grp", "v").agg(F.count("*").alias("n")).withColumn("_s", names.scalar())
    counts = counts.where("grp = _s.a or grp = _s.b")
    by_value = counts.groupBy("v").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("grp") == F.col("_s.a"), F.col("n")).otherwise(0)).alias("n1"),
    )
    # One running count serves the ranks and both medians: n1 runs beside n.
    ranked = prefix_sum(by_value, ["v"], {"_upto": "n", "_u1": "n1"}, totals={"_t": "n", "_t1": "n1"})
    rank = F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2.0
    n_d = F.col("n").cast("double")
    sides = {"1": (F.col("_u1"), F.col("n1"), F.col("_t1")), "2": (F.col("_upto") - F.col("_u1"), F.col("n") - F.col("n1"), F.col("_t") - F.col("_t1"))}
    middles = []
    for side, (upto, count, total) in sides.items():
        position = 0.5 * (total - 1)
        for end, place in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (count > 0) & (place < upto) & (place >= upto - count)
            middles.append(F.max(F.when(hit, F.col("v"))).alias(f"_{end}{side}"))
    sums = ranked.agg(
        F.sum("n1").alias("n1"),
        F.sum(F.col("n") - F.col("n1")).alias("n2"),
        F.sum(F.col("n1") * rank).alias("_r1"),
        F.sum(n_d**3 - n_d).alias("_ties"),
        F.max("n").alias("_widest"),
        *middles,
    )

    def median(side: str, size: Column) -> Column:
        position = 0.5 * (size - 1)
        lo, hi = F.col(f"_lo{side}"), F.col(f"_hi{side}")
        return lo + (hi - lo) * (position - F.floor(position))

    m1, m2 = median("1", F.col("n1")), median("2", F.col("n2"))
    first, second = F.col("_s.a").cast("string"), F.col("_s.b").cast("string")
    sums = sums.withColumn("_s", names.scalar()).withColumn(
        "_m",
        F.struct(
            F.struct(F.when(F.col("n1") > 0, first).otherwise(second).alias("grp"), F.when(F.col("n1") > 0, m1).otherwise(m2).alias("median")).alias("a"),
            F.struct(F.when(F.col("n2") > 0, second).otherwise(first).alias("grp"), F.when(F.col("n2") > 0, m2).otherwise(m1).alias("median")).alias("b"),
        ),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    top = F.greatest(u1, n1 * n2 - u1)
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = F.when(sigma > 0, (top - n1 * n2 / 2 - 0.5) / sigma)
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method {method!r}")
    small = (F.least("n1", "n2") <= EXACT_GROUP) & (F.col("_widest") == 1)
    exact = {"auto": small, "exact": F.lit(True), "normal": F.lit(False)}[method]
    base = sums.select(
        F.col("_m.a.grp").cast("string").alias("group1"),
        F.col("_m.b.grp").cast("string").alias("group2"),
        "n1",
        "n2",
        F.col("_m.a.median").alias("median1"),
        F.col("_m.b.median").alias("median2"),
        u1.alias("u_stat"),
        F.when(n1 * n2 > 0, 1 - 2 * u1 / (n1 * n2)).otherwise(0.0).alias("rank_biserial"),
        top.alias("_top"),
        z.alias("_z"),
        exact.alias("_exact"),
    )
    normal = F.when(F.col("_z") <= 0, 1.0).otherwise(F.least(F.lit(1.0), normal_two_sided(F.col("_z"))))
    return (
        base.withColumn("_normal", normal)
        .withColumn("p_value", F.coalesce(_exact_u("_top", "n1", "n2", "_exact"), F.col("_normal")))
        .withColumn("significant", F.col("p_value") < ALPHA)
        .drop("_top", "_z", "_exact", "_normal")
    )


def levene(df: DataFrame, target: str, group: str, least: int = 5) -> DataFrame:
    """Median-centred Levene test over all groups with enough rows."""
    rows = df.select(quoted(group).alias("grp"), number(target).alias("v")).where("grp is not null")
    # "Enough" counts rows of the group, present or not.
    big = (
        rows.groupBy("grp")
        .agg(F.count("*").alias("_n"), F.count("v").alias("_p"))
        .where(f"_n >= {least}")
        .where("_p > 0")
    )
    counts = (
        rows.where("v is not null")
        .groupBy("grp", "v")
        .agg(F.count("*").alias("n"))
        .join(big.select("grp"), "grp")
    )
    centre = weighted_quantiles(counts, "v", {"median": 0.5}, ["grp"]).select("grp", "median")
    spread = counts.join(centre, "grp").withColumn("d", F.abs(F.col("v") - F.col("median")))
    means = spread.groupBy("grp").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("mean")
    )
    within = (
        spread.join(means.select("grp", "mean", F.col("n").alias("_n")), "grp")
        .groupBy("grp")
        .agg(
            F.max("_n").alias("n"),
            F.max("mean").alias("mean"),
            (F.sum(F.col("n") * (F.col("d") - F.col("mean")) ** 2) / F.nullif(F.max("_n") - 1, F.lit(0))).alias("var"),
        )
    )
    return f_table(within).select("groups", F.col("f_stat").alias("w_stat"), "p_value")
