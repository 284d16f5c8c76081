"""Frequent itemsets and association rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from statloom.roles import ITEM_WORDS, TRANSACTION_WORDS, keyword_columns, quoted

# Thresholds (fixed values).
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.3
MIN_LIFT = 1.0


def basket_columns(df: DataFrame, params: dict) -> tuple[str, str]:
    """Transaction and item column: parameters first, then the last keyword match."""
    tids, items = keyword_columns(df.columns, TRANSACTION_WORDS), keyword_columns(df.columns, ITEM_WORDS)
    tid = params.get("group_column") or (tids[-1] if tids else None)
    item = params.get("target_column") or (items[-1] if items else None)
    if not tid or not item:
        raise ValueError("market basket needs a transaction column and an item column")
    return tid, item


def basket_shape(df: DataFrame, transaction: str, item: str) -> DataFrame:
    """Do both columns repeat? A sketch is enough for the confirmation."""
    return df.agg(
        F.count("*").alias("rows"),
        F.approx_count_distinct(quoted(transaction)).alias("transactions"),
        F.approx_count_distinct(quoted(item)).alias("items"),
    ).withColumn("transactional", (F.col("transactions") < F.col("rows")) & (F.col("items") < F.col("rows")))


def baskets(df: DataFrame, transaction: str, item: str) -> DataFrame:
    """(tid, items): distinct items per transaction, folded map-side."""
    return (
        df.select(quoted(transaction).alias("tid"), quoted(item).cast("string").alias("item"))
        .where("tid is not null and item is not null")
        .groupBy("tid")
        .agg(F.collect_set("item").alias("items"))
    )


def frequent_itemsets(df: DataFrame, transaction: str, item: str, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(items sorted, length, freq, support, transactions) with support ≥ the threshold."""
    table = baskets(df, transaction, item).persist()
    total = table.count()
    # FPGrowth keeps sets with freq ≥ ceil(support · total).
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=MIN_CONFIDENCE).fit(table.select("items"))
    sets = model.freqItemsets
    table.unpersist()
    return sets.select(
        F.array_sort("items").alias("items"),
        F.size("items").alias("length"),
        "freq",
        (F.col("freq") / F.lit(float(total))).alias("support"),
        F.lit(total).cast("long").alias("transactions"),
    )


def association_rules(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """(antecedent, consequent, support, confidence, lift); both sides may hold several items.

    Every non-trivial subset of a frequent itemset is frequent too, so each rule is found by two
    equi-joins of the itemset table with itself.
    """
    known = itemsets.select("items", "support")
    masks = F.expr("sequence(1L, shiftleft(1L, length) - 2)")
    split = itemsets.where("length > 1").select("items", "support", F.explode(masks).alias("mask"))
    taken = lambda bit: F.filter("items", lambda x, i: F.getbit("mask", i) == bit)
    sides = split.select("support", taken(1).alias("antecedent"), taken(0).alias("consequent"))
    left = known.select(F.col("items").alias("antecedent"), F.col("support").alias("a"))
    right = known.select(F.col("items").alias("consequent"), F.col("support").alias("c"))
    rules = sides.join(left, "antecedent").join(right, "consequent")
    confidence = F.col("support") / F.col("a")
    return rules.select(
        "antecedent", "consequent", "support", confidence.alias("confidence"), (confidence / F.col("c")).alias("lift")
    ).where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def top_rules(rules: DataFrame, k: int = 15) -> DataFrame:
    return rules.orderBy(F.desc("lift"), F.desc("confidence"), "antecedent", "consequent").limit(k)
