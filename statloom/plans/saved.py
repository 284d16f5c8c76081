"""Named batch plans, kept as rows of an append-only table."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F


class SavedPlans:
    """Every change appends a row; of a name's rows the latest counts, unless it retires the plan.

    The table lies in any folder Spark reaches, so plans are shared by all who run on the cluster, and
    a failed append leaves what was there. Parameters of a step are JSON text.
    """

    SCHEMA = (
        "plan string, note string, steps array<struct<analysis_id:string,params:string>>, columns array<string>, "
        "changed_at timestamp, retired boolean"
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, plan: str, note: str, steps: list, columns: list[str] | None, retired: bool) -> None:
        row = (plan, note, steps, columns, datetime.now(timezone.utc), retired)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def current(self) -> DataFrame:
        """The plans in force, one row each."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        newest = rows.groupBy("plan").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "plan"]), "changed_at").alias("r"))
        return newest.select("plan", "r.*").where("not retired")

    def put(self, plan: str, steps: list[tuple[str, dict]], columns: list[str] | None = None, note: str = "") -> None:
        self._append(plan, note, [(i, json.dumps(p, ensure_ascii=False)) for i, p in steps], columns, False)

    def retire(self, plan: str) -> None:
        self._append(plan, "", [], None, True)

    def steps(self, plan: str) -> tuple[list[tuple[str, dict]], list[str] | None]:
        """(analysis, parameters) steps and the chosen columns; an unknown plan is an error."""
        row = self.current().where(F.col("plan") == plan).first()
        if row is None:
            raise KeyError(plan)
        return [(s["analysis_id"], json.loads(s["params"])) for s in row["steps"]], row["columns"]
