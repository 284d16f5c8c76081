"""Reading tables by file extension and summarising what was loaded."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

# Extensions per format (fixed values).
CSV_EXTENSIONS = {".csv", ".tsv"}
WORKBOOK_EXTENSIONS = {".xlsx", ".xlsm"}
SQLITE_EXTENSIONS = {".db", ".sqlite", ".sqlite3"}
DUMP_EXTENSIONS = {".sql"}


def read_source(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables of a source, by name. ``tables`` picks sheets or tables of a multi-table source."""
    stem, extension = os.path.splitext(os.path.basename(path.rstrip("/")))
    extension = extension.lower()
    if extension in CSV_EXTENSIONS:
        return {stem: read_delimited(spark, path)}
    if extension == ".parquet":
        return {stem: spark.read.parquet(path)}
    if extension in (".json", ".jsonl"):
        return {stem: spark.read.json(path)}
    if extension in WORKBOOK_EXTENSIONS:
        from statloom.sources.workbook import read_workbooks

        return read_workbooks(spark, path, tables)
    if extension in SQLITE_EXTENSIONS:
        from statloom.sources.sqlite import read_sqlite

        return read_sqlite(spark, path, tables)
    if extension in DUMP_EXTENSIONS:
        from statloom.sources.dump import read_dump

        return read_dump(spark, path, tables)
    raise ValueError(f"unsupported format: {extension!r}")


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, schema: str | None = None) -> DataFrame:
    """CSV or TSV with a header. A given schema saves the inference pass over the data."""
    sep = separator or ("\t" if path.rstrip("/").lower().endswith(".tsv") else ",")
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def catalog_summary(tables: dict[str, DataFrame], columns: int = 8) -> DataFrame:
    """(table, rows, column, type, ordinal, more): the first columns of every table and how many follow."""
    parts = []
    for name, df in tables.items():
        shown = df.dtypes[:columns]
        facts = F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.lit(i + 1).alias("ordinal"))
                for i, (c, t) in enumerate(shown)
            ]
        )
        counted = df.agg(F.count("*").alias("rows"))
        parts.append(
            counted.select(
                F.lit(name).alias("table"),
                "rows",
                F.inline(facts),
                F.lit(max(0, len(df.columns) - columns)).alias("more"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
