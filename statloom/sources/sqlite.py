"""Read-only SQLite tables as a Spark data source.

A path is one database file or a folder of database files with the same tables. Every file is cut
into rowid ranges, so executors read in parallel. The files must lie in a folder that all executors
can reach, as any other file.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from statloom.operators.relational import view_name

ROWS_PER_PARTITION = 500_000
# Declared type to Spark type by SQLite's affinity rules (fixed values).
AFFINITIES = [("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"),
              ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("NUM", "double"), ("DEC", "double")]


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def database_files(path: str) -> list[str]:
    if os.path.isdir(path):
        names = sorted(os.listdir(path))
        return [os.path.join(path, n) for n in names if n.endswith((".db", ".sqlite", ".sqlite3"))]
    return [path]


def table_names(path: str) -> list[str]:
    found: list[str] = []
    for file in database_files(path):
        con = _open(file)
        try:
            rows = con.execute(
                "SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name"
            )
            found += [r[0] for r in rows if r[0] not in found]
        finally:
            con.close()
    return found


def _spark_type(declared: str) -> str:
    upper = (declared or "").upper()
    return next((t for word, t in AFFINITIES if word in upper), "string")


class RowidRange(InputPartition):
    def __init__(self, file: str, low: int | None, high: int | None):
        self.file, self.low, self.high = file, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.path, self.table = options["path"], options["table"]
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def partitions(self) -> list[RowidRange]:
        out = []
        for file in database_files(self.path):
            con = _open(file)
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                has = con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (self.table,)).fetchone()
                if has:  # a table without rowid is read whole
                    out.append(RowidRange(file, None, None))
                continue
            finally:
                con.close()
            if low is not None:
                out += [
                    RowidRange(file, at, min(high, at + ROWS_PER_PARTITION - 1))
                    for at in range(low, high + 1, ROWS_PER_PARTITION)
                ]
        return out

    def read(self, partition: RowidRange) -> Iterator[tuple]:
        names = ", ".join(_quoted(c) for c, _ in self.columns)
        text, args = f"SELECT {names} FROM {_quoted(self.table)}", ()
        if partition.low is not None:
            text, args = text + " WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)
        casts = {"bigint": int, "double": float, "string": str}
        makers = [casts[t] for _, t in self.columns]
        con = _open(partition.file)
        try:
            for row in con.execute(text, args):
                yield tuple(None if v is None else make(v) for make, v in zip(makers, row))
        finally:
            con.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        for file in database_files(self.options["path"]):
            con = _open(file)
            try:
                columns = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
            finally:
                con.close()
            if columns:
                return ", ".join(f"`{c[1]}` {_spark_type(c[2])}" for c in columns)
        raise ValueError(f"no table {self.options['table']!r}")

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """All user tables, or the chosen ones."""
    spark.dataSource.register(SqliteSource)
    return {
        view_name(t): spark.read.format("sqlite_table").option("table", t).load(path)
        for t in table_names(path)
        if tables is None or t in tables
    }
