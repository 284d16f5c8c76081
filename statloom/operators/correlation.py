"""Pearson and Spearman correlation of all numeric pairs, pairwise complete."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from statloom.functions.ordered import prefix_sum
from statloom.roles import number, quoted, roles
from statloom.session import cut_lineage, discard

PAIRS_PER_PASS = 300


def _corr(x: Column, y: Column) -> Column:
    """Pearson over the rows where both are present; null where either does not vary.

    A column that does not vary has a spread of exactly 0 (its running squared deviations never
    grow, also when partial results are merged), so the division gives null there.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), spread)


def pearson_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col1, col2, pearson) per pair; one aggregation serves up to 300 pairs."""
    columns = columns or roles(df).numeric
    pairs = list(combinations(columns, 2))
    parts = []
    for at in range(0, len(pairs), PAIRS_PER_PASS):
        facts = [
            F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), _corr(number(a), number(b)).alias("pearson"))
            for a, b in pairs[at : at + PAIRS_PER_PASS]
        ]
        one = df.agg(*[f.alias(f"p{i}") for i, f in enumerate(facts)])
        parts.append(one.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(facts))]))))
    return reduce(DataFrame.unionByName, parts)


def spearman_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col1, col2, spearman) with average ranks on ties, ranks taken within each pair's complete rows.

    Without missing values (one cheap aggregation tells) a column has the same ranks in all its
    pairs, so each column is ranked once; otherwise ranks are taken per pair.
    """
    columns = columns or roles(df).numeric
    missing = df.agg(*[F.count_if(number(c).isNull()) for c in columns]).first()
    if not any(missing):
        return _shared_ranks(df, columns)
    pairs = list(combinations(columns, 2))
    values = df.select(*[(number(c) + F.lit(0.0)).alias(c) for c in columns])
    packed = F.array(
        *[
            F.struct(F.lit(i).alias("pair"), quoted(a).alias("x"), quoted(b).alias("y"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    cells = (
        values.select(F.inline(packed))
        .where("x is not null and y is not null")
        .groupBy("pair", "x", "y")
        .agg(F.count("*").alias("n"))
    )

    def ranks(side: str) -> DataFrame:
        marginal = cells.groupBy("pair", side).agg(F.sum("n").alias("_c"))
        ranked = prefix_sum(marginal, [side], {"_upto": "_c"}, ["pair"], {"_n": "_c"})
        average = F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2.0
        return ranked.select(
            F.col("pair").alias(f"_p{side}"),
            F.col(side).alias(f"_v{side}"),
            (average - (F.col("_n") + 1) / 2.0).alias(f"r{side}"),
        )

    # A value that fills much of a column is a large join key; adaptive execution splits it.
    joined = cells.join(ranks("x"), (F.col("pair") == F.col("_px")) & (F.col("x") == F.col("_vx"))).join(
        ranks("y"), (F.col("pair") == F.col("_py")) & (F.col("y") == F.col("_vy"))
    )
    sums = joined.groupBy("pair").agg(
        F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("xy"),
        F.sum(F.col("n") * F.col("rx") ** 2).alias("xx"),
        F.sum(F.col("n") * F.col("ry") ** 2).alias("yy"),
    )
    rho = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    names = F.array(*[F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2")) for a, b in pairs])
    named = sums.select(F.get(names, F.col("pair")).alias("k"), rho.alias("spearman"))
    return named.select("k.col1", "k.col2", "spearman")


#: A value with at least 1/HEAVY of the rows is ranked by broadcast; heavy rows spread over SALTS keys.
HEAVY, SALTS = 1000, 1024


def _shared_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman of complete columns: one rank table per column, joined to the rows by value.

    Heavy values (each holding at least 1/``HEAVY`` of the rows, so at most ``HEAVY`` of them)
    take their rank from a broadcast table; the other rows join the rest of the rank table by a
    shuffle on the value, where heavy rows carry a salt that matches nothing and so spread over
    all tasks. No value lands in one task with its rows. Value counts and rank tables are written
    once, as each is read several times.
    """
    values = [f"v{i}" for i in range(len(columns))]
    rows = df.select(*[(number(c) + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns)])
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*values), F.lit(SALTS)) + 1)
    ranked = rows
    for i in range(len(columns)):
        v = f"v{i}"
        counts = cut_lineage(rows.groupBy(v).agg(F.count("*").alias("_c")))
        table = cut_lineage(
            prefix_sum(counts, [v], {"_upto": "_c"}, totals={"_all": "_c"}).select(
                v, "_c", "_all", (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias("_r")
            )
        )
        discard(counts)
        heavy = table.where(F.col("_c") * HEAVY >= F.col("_all")).select(F.col(v).alias("_hv"), F.col("_r").alias("_hr"))
        light = table.where(F.col("_c") * HEAVY < F.col("_all")).select(F.col(v).alias("_lv"), F.col("_r").alias("_lr"))
        ranked = ranked.join(F.broadcast(heavy), F.col(v) == F.col("_hv"), "left")
        rank = F.col("_hr")
        if light.limit(1).count():  # a column of heavy values alone needs no shuffle of the rows
            salt = F.when(F.col("_hr").isNull(), F.lit(0)).otherwise(F.col("_salt"))
            ranked = ranked.join(light.withColumn("_ls", F.lit(0)), (F.col(v) == F.col("_lv")) & (salt == F.col("_ls")), "left")
            rank = F.coalesce("_hr", "_lr")
        ranked = ranked.select(*[c for c in ranked.columns if not c.startswith(("_h", "_l")) and c != v],
                               rank.alias(f"r{i}")).where(F.col(f"r{i}").isNotNull())
    pairs = list(combinations(range(len(columns)), 2))
    facts = [
        F.struct(F.lit(columns[i]).alias("col1"), F.lit(columns[j]).alias("col2"), _corr(F.col(f"r{i}"), F.col(f"r{j}")).alias("spearman"))
        for i, j in pairs
    ]
    one = ranked.agg(*[f.alias(f"p{i}") for i, f in enumerate(facts)])
    return one.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(facts))])))


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Both coefficients, a row per pair of columns."""
    return pearson_pairs(df, columns).join(F.broadcast(spearman_pairs(df, columns)), ["col1", "col2"], "left")


def top_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc_nulls_last(F.abs("pearson")), "col1", "col2").limit(k)


def heat_map(pairs: DataFrame, columns: list[str], measure: str = "pearson") -> DataFrame:
    """Long form of the symmetric matrix, diagonal included."""
    mirrored = pairs.select(F.col("col1").alias("row"), F.col("col2").alias("col"), measure).unionByName(
        pairs.select(F.col("col2").alias("row"), F.col("col1").alias("col"), measure)
    )
    diagonal = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], f"row string, col string, {measure} double")
    return mirrored.unionByName(diagonal)
