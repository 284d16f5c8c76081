"""Result sinks and the results log."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from statloom.operators.profile import profile_report
from statloom.plans.catalogue import NAMES, Outcome, metric_rows
from statloom.session import cut_lineage


def detail_table(outcome: Outcome, rows: int | None = None) -> DataFrame | None:
    """The main table of an outcome, whole unless a report asks for ``rows`` of it."""
    if not outcome.success or outcome.detail not in outcome.tables:
        return None
    table = outcome.tables[outcome.detail]
    return table if rows is None else table.limit(rows)


def _flat(table: DataFrame, format: str) -> DataFrame:
    """CSV holds no arrays or structs: they become JSON text."""
    if format != "csv":
        return table
    nested = {f.name for f in table.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    return table.select(*[F.to_json(F.col(c)).alias(c) if c in nested else F.col(c) for c in table.columns])


def write_results(
    outcomes: list[Outcome], path: str, format: str = "parquet", mode: str = "overwrite"
) -> list[tuple[str, str, str]]:
    """Every table of every successful outcome under ``path/analysis_id=.../table``, written in parallel by Spark.

    Returns (analysis, table, error) of those that could not be made; the others are written all the same.
    """
    failed = []
    for outcome in outcomes:
        for name, table in outcome.tables.items():
            try:
                _flat(table, format).write.mode(mode).option("header", True).format(format).save(
                    f"{path}/analysis_id={outcome.analysis_id}/{name}"
                )
            except Exception as e:
                failed.append((outcome.analysis_id, name, f"{type(e).__name__}: {e}"))
    return failed


def write_profile(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    for name, table in profile_report(df).items():
        _flat(table, format).write.mode(mode).option("header", True).format(format).save(f"{path}/{name}")


def quality_sheet(checks: DataFrame) -> DataFrame:
    """(analysis_id, status, details) plus an overall row, from (analysis_id, check columns) rows.

    Checks are a handful of rows per analysis; they are computed once for the rows and the overall one.
    """
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.concat(F.lit("- "), "message"))))
    per = checks.groupBy("analysis_id").agg(
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("ok"), failed.alias("lines")
    )
    sheet = cut_lineage(per).select(
        "analysis_id",
        F.when(F.col("ok"), "passed").otherwise("warning").alias("status"),
        F.when(F.col("ok"), "all assumptions met").otherwise(F.array_join("lines", "\n")).alias("details"),
    )
    warnings = F.count_if(F.col("status") == "warning")
    overall = sheet.agg(warnings.alias("w")).select(
        F.lit("(overall)").alias("analysis_id"),
        F.when(F.col("w") == 0, "good").otherwise(F.format_string("%d warnings", "w")).alias("status"),
        F.lit("").alias("details"),
    )
    return sheet.unionByName(overall)


class ResultsLog:
    """Sessions and results as append-only tables in a folder.

    Appends never rewrite earlier files, so a failed job leaves the log intact. A deletion is one
    appended row, honoured by an anti join on read; ``compact`` drops deleted rows for good.
    """

    SESSIONS = "session_id string, file_path string, file_name string, created_at timestamp, row_count long, col_count int, engine string"
    RESULTS = (
        "result_id string, session_id string, analysis_id string, analysis_name string, success boolean, "
        "summary array<struct<metric:string,value:string>>, interpretation string, created_at timestamp, position long"
    )
    DELETED = "session_id string, deleted_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def create_session(self, file_path: str, row_count: int, col_count: int, engine: str = "spark") -> str:
        session_id = str(uuid.uuid4())
        row = (session_id, file_path, file_path.rstrip("/").split("/")[-1], datetime.now(timezone.utc), row_count, col_count, engine)
        self._append("sessions", self.spark.createDataFrame([row], self.SESSIONS))
        return session_id

    def save_result(self, session_id: str, outcome: Outcome, interpretation: str = "") -> str:
        """Log the headline numbers of an outcome; its tables go to ``write_results``."""
        result_id = str(uuid.uuid4())
        try:  # the tables are lazy, so they may fail only now
            metrics = metric_rows(self.spark, outcome).orderBy("position").collect()
        except Exception as e:
            outcome, metrics = Outcome(outcome.analysis_id, error=f"{type(e).__name__}: {e}"), []
        now = datetime.now(timezone.utc)
        row = (
            result_id,
            session_id,
            outcome.analysis_id,
            NAMES.get(outcome.analysis_id, outcome.analysis_id),
            outcome.success,
            [(r["metric"], r["value"]) for r in metrics] if outcome.success else [("error", outcome.error)],
            interpretation,
            now,
            int(now.timestamp() * 1e6),
        )
        self._append("results", self.spark.createDataFrame([row], self.RESULTS))
        return result_id

    def _live(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema).join(self._read("deleted", self.DELETED), "session_id", "left_anti")

    def sessions(self) -> DataFrame:
        return self._live("sessions", self.SESSIONS)

    def results(self, session_id: str) -> DataFrame:
        return self._live("results", self.RESULTS).where(F.col("session_id") == session_id).orderBy("position")

    def recent_sessions(self, limit: int = 10) -> DataFrame:
        return self.sessions().orderBy(F.desc("created_at"), "session_id").limit(limit)

    def delete_session(self, session_id: str) -> None:
        self._append("deleted", self.spark.createDataFrame([(session_id, datetime.now(timezone.utc))], self.DELETED))

    def compact(self, path: str) -> "ResultsLog":
        """Write the live rows to another folder and return the log there."""
        self.sessions().write.mode("overwrite").parquet(f"{path}/sessions")
        self._live("results", self.RESULTS).write.mode("overwrite").parquet(f"{path}/results")
        return ResultsLog(self.spark, path)

    def findings(self, session_id: str, last: int = 5, metrics: int = 3) -> DataFrame:
        return key_findings(self.results(session_id), last, metrics)


def key_findings(results: DataFrame, last: int = 5, metrics: int = 3) -> DataFrame:
    """(analysis_name, finding) of the last results: the interpretation's head, else the first metrics."""
    first = F.slice("summary", 1, metrics)
    text = F.array_join(F.transform(first, lambda e: F.concat(e["metric"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "; ")
    finding = (
        F.when(F.length(F.coalesce("interpretation", F.lit(""))) > 0, F.substring("interpretation", 1, 200))
        .when(F.size("summary") > 0, text)
        .otherwise(F.col("analysis_name"))
    )
    return results.orderBy(F.desc("position")).limit(last).orderBy("position").select("analysis_name", finding.alias("finding"))


def combine_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """Check rows of several analyses tagged with their id."""
    tagged = [df.select(F.lit(i).alias("analysis_id"), "*") for i, df in checks.items()]
    return reduce(DataFrame.unionByName, tagged)
