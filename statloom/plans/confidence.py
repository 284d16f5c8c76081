"""Confidence of a result from table size, missing values, failed checks and model fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Penalties and bonuses (fixed values).
SIZE_STEPS = [(30, 0.40), (100, 0.20), (500, 0.10)]
MISSING_STEPS = [(0.50, 0.30), (0.20, 0.15)]
FAILED_CHECK, FAILED_MOST = 0.10, 0.35
WEAK_R2, WEAK_R2_LOSS, STRONG_R2, STRONG_R2_GAIN = 0.3, 0.20, 0.7, 0.05
WEAK_SILHOUETTE, WEAK_SILHOUETTE_LOSS = 0.3, 0.15


def confidence(facts: DataFrame) -> DataFrame:
    """Add ``score`` (0..1, 2 digits) and ``reasons`` to rows of (rows, missing_share, failed, r2, silhouette)."""
    rows, missing, failed = F.col("rows"), F.coalesce("missing_share", F.lit(0.0)), F.coalesce("failed", F.lit(0))
    r2, silhouette = F.col("r2"), F.col("silhouette")
    size = F.when(rows < SIZE_STEPS[0][0], SIZE_STEPS[0][1])
    for limit, loss in SIZE_STEPS[1:]:
        size = size.when(rows < limit, loss)
    gaps = F.when(missing > MISSING_STEPS[0][0], MISSING_STEPS[0][1]).when(missing > MISSING_STEPS[1][0], MISSING_STEPS[1][1])
    loss = (
        size.otherwise(0.0)
        + gaps.otherwise(0.0)
        + F.least(failed * FAILED_CHECK, F.lit(FAILED_MOST))
        + F.when(r2 < WEAK_R2, WEAK_R2_LOSS).when(r2 > STRONG_R2, -STRONG_R2_GAIN).otherwise(0.0)
        + F.when(silhouette < WEAK_SILHOUETTE, WEAK_SILHOUETTE_LOSS).otherwise(0.0)
    )
    reasons = F.array(
        F.when(rows < 30, F.format_string("very small table (%d rows)", rows)).when(
            rows < 100, F.format_string("small table (%d rows)", rows)
        ),
        F.when(missing > 0.5, F.format_string("many missing values (%.0f%%)", missing * 100)).when(
            missing > 0.2, F.format_string("some missing values (%.0f%%)", missing * 100)
        ),
        F.when(failed > 0, F.format_string("%d assumptions not met", failed)),
        F.when(r2 < WEAK_R2, F.format_string("low R2 (%.2f)", r2)),
        F.when(silhouette < WEAK_SILHOUETTE, F.format_string("low silhouette (%.2f)", silhouette)),
    )
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - loss)), 2)
    return facts.withColumn("score", score).withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull()))
