"""Batch runs: every step is checked, run, scored and collected."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from statloom.operators.profile import profile_summary
from statloom.operators.relational import select_columns
from statloom.plans.catalogue import ANALYSES, Outcome, run_analysis
from statloom.plans.confidence import confidence
from statloom.plans.guardrails import check_assumptions, guardrail_summary
from statloom.plans.saved import SavedPlans

FALLBACK = "descriptive_stats"


@dataclass
class BatchResult:
    outcomes: list[Outcome]
    checks: dict[str, DataFrame]
    scores: DataFrame


def run_batch(
    df: DataFrame, steps: list[tuple[str, dict]], columns: list[str] | None = None, parallel: int = 4
) -> BatchResult:
    """Run the known steps; an empty plan becomes the descriptive statistics.

    The table is cached once and independent steps are submitted together.
    """
    spark = df.sparkSession
    chosen = select_columns(df, columns).persist()
    plan = [(i, p) for i, p in steps if i in ANALYSES] or [(FALLBACK, {})]

    def step(item: tuple[str, dict]) -> tuple[Outcome, DataFrame, tuple]:
        analysis_id, params = item
        checks = check_assumptions(chosen, analysis_id, params)
        failed = guardrail_summary(checks, analysis_id).first()["failed"]
        outcome = run_analysis(chosen, analysis_id, params)
        fit = {"r2": None, "silhouette": None}
        if outcome.success and outcome.metrics:
            metrics = outcome.tables[outcome.metrics]
            wanted = [c for c in fit if c in metrics.columns]
            try:  # tables are lazy: an unusable input may show only here
                if wanted:
                    fit.update(metrics.select(*wanted).first().asDict())
            except Exception as e:
                outcome = Outcome(analysis_id, error=f"{type(e).__name__}: {e}")
        return outcome, checks, (analysis_id, failed, fit["r2"], fit["silhouette"])

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        done = list(pool.map(step, plan))
    facts = spark.createDataFrame([row for _, _, row in done], "analysis_id string, failed long, r2 double, silhouette double")
    profile = profile_summary(chosen).select(
        F.struct("row_count", (F.col("total_missing") / F.nullif(F.col("row_count") * F.col("col_count"), F.lit(0))).alias("share"))
    )
    sized = facts.withColumn("_p", profile.scalar()).select(
        "*", F.col("_p.row_count").alias("rows"), F.col("_p.share").alias("missing_share")
    ).drop("_p")
    return BatchResult([o for o, _, _ in done], {row[0]: c for _, c, row in done}, confidence(sized))


def run_saved(df: DataFrame, plans: SavedPlans, name: str, parallel: int = 4) -> BatchResult:
    """Run a saved plan; its columns override the table's, and null means all columns."""
    steps, columns = plans.steps(name)
    return run_batch(df, steps, columns, parallel)
