"""Helpers for registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded (per column where given), counts as bigint; -0.0 becomes 0.0."""
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), special.get(f.name, digits)) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def f_tail(source: str, name: str = "ft", terms: int = 3000) -> str:
    """CTEs computing p = P(F > f) for rows (id, f, d1, d2) by the power series with lgamma."""
    return f"""
{name}_x AS (SELECT id, f, d1/2.0::DOUBLE AS a, d2/2.0::DOUBLE AS b, (d1*f)/(d1*f+d2) AS x FROM {source} WHERE f > 0),
{name}_t AS (SELECT id, a, b, x, k, sum(CASE WHEN k = 0 THEN 0.0 ELSE ln((a+b+k-1)/(a+k)*x) END)
    OVER (PARTITION BY id ORDER BY k) AS lt FROM {name}_x, range(0, {terms}) r(k)),
{name} AS (SELECT id, greatest(0.0, 1 - sum(exp(lt + a*ln(x) + b*ln(1-x) - ln(a) - lgamma(a) - lgamma(b) + lgamma(a+b)))) AS p
    FROM {name}_t GROUP BY id)"""


def chi2_tail(source: str, name: str = "ct", terms: int = 3000) -> str:
    """CTEs computing p = P(X > x) for rows (id, x, dof) by the series of the lower incomplete gamma."""
    return f"""
{name}_x AS (SELECT id, dof/2.0::DOUBLE AS a, x/2.0::DOUBLE AS h FROM {source} WHERE x > 0),
{name}_t AS (SELECT id, a, h, k, sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(h/(a+k)) END)
    OVER (PARTITION BY id ORDER BY k) AS lt FROM {name}_x, range(0, {terms}) r(k)),
{name} AS (SELECT id, greatest(0.0, 1 - sum(exp(lt + a*ln(h) - h - lgamma(a+1)))) AS p FROM {name}_t GROUP BY id)"""


# A customer table with missing values and repeated rows, the same in both engines.
DIRTY_SQL = """
base AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS c_mktsegment FROM customer),
dirty AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE c_acctbal > 9000)"""


def dirty_customer(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "customer").select(
        "c_custkey",
        "c_nationkey",
        F.expr("CASE WHEN c_acctbal >= 0 THEN c_acctbal END").alias("c_acctbal"),
        F.expr("CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END").alias("c_mktsegment"),
    )
    return base.unionByName(base.where("c_acctbal > 9000"))


# Days from an order to the customer's next one; the last order is censored at the table's last date.
SURVIVAL_SQL = """
seq AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d,
  lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders),
surv AS (SELECT date_diff('day', d, coalesce(nx, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders))) AS duration,
  CASE WHEN nx IS NULL THEN 0 ELSE 1 END AS event, c_mktsegment AS segment
  FROM seq JOIN customer ON o_custkey = c_custkey)"""


def reorder_times(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    orders = table(spark, folder, "orders").withColumn("d", F.to_date("o_orderdate"))
    line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    nxt = orders.select("o_custkey", "d", F.lead("d").over(line).alias("nx"))
    last = orders.agg(F.max("d"))
    return (
        nxt.withColumn("last", last.scalar())
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.datediff(F.coalesce("nx", "last"), "d").alias("duration"),
            F.when(F.col("nx").isNull(), 0).otherwise(1).alias("event"),
            F.col("c_mktsegment").alias("segment"),
        )
    )


def daily_orders(spark: SparkSession, folder: str) -> DataFrame:
    """(day, total_price, order_count, avg_price) per order date."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderdate").alias("day"))
        .agg(F.sum("o_totalprice").alias("total_price"), F.count("*").alias("order_count"))
    )


DAILY_SQL = """
daily AS (SELECT o_orderdate AS day, sum(o_totalprice) AS total_price, count(*) AS order_count FROM orders GROUP BY 1)"""
