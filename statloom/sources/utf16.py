"""UTF-16 text in byte ranges: a Python data source that cuts files at two-byte line breaks.

A line break in UTF-16 is two bytes, so Spark's line reader cannot split such files and its CSV
reader reads each file whole in one task. Here every file is cut into byte ranges; a range owns the
lines that start inside it, found by scanning for a line break at an even offset after the
byte-order mark, and reads on past its end to finish its last line. Quoted fields may hold line
breaks: the quotes of each line are counted, their running sum along the file (a distributed
prefix sum) tells which lines continue a record, and lines are gathered to records by that sum.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from statloom.functions.ordered import prefix_sum
from statloom.session import cut_lineage, scratch_path

SPLIT_BYTES = 64 * 1024 * 1024
# Byte-order marks and line breaks of the two byte orders.
MARKS = {b"\xff\xfe": ("utf-16-le", b"\n\x00"), b"\xfe\xff": ("utf-16-be", b"\x00\n")}


def _open(path: str):
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return filesystem.open_input_file(inner)


class _Reader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], split: int):
        self.files, self.split = files, split

    def partitions(self) -> list[InputPartition]:
        return [
            InputPartition((path, start, min(start + self.split, size)))
            for path, size in self.files
            for start in range(0, max(size, 1), self.split)
        ]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, start, end = partition.value
        with _open(path) as stream:
            mark = stream.read(2)
            encoding, newline = MARKS.get(mark, ("utf-16-le", b"\n\x00"))
            base = 2 if mark in MARKS else 0
            pos = max(start, base)
            pos += (pos - base) % 2
            if pos > base:
                stream.seek(pos - 2)
                pos = self._after_break(stream, pos - 2, newline)
            if pos is None or pos >= end:
                return
            stream.seek(pos)
            buffer, at = b"", pos
            while at < end:
                line, at_next, buffer = self._line(stream, buffer, at, newline)
                if line is None:
                    return
                text = line.decode(encoding, errors="replace")
                yield (path, at, text[:-1] if text.endswith("\r") else text)
                at = at_next

    @staticmethod
    def _after_break(stream, at: int, newline: bytes) -> int | None:
        while True:
            chunk = stream.read(1 << 16)
            if not chunk:
                return None
            for i in range(0, len(chunk) - 1, 2):
                if chunk[i : i + 2] == newline:
                    return at + i + 2
            at += len(chunk) - len(chunk) % 2
            stream.seek(at)

    @staticmethod
    def _line(stream, buffer: bytes, at: int, newline: bytes) -> tuple[bytes | None, int, bytes]:
        searched = 0
        while True:
            for i in range(searched, len(buffer) - 1, 2):
                if buffer[i : i + 2] == newline:
                    return buffer[:i], at + i + 2, buffer[i + 2 :]
            searched = len(buffer) - len(buffer) % 2
            chunk = stream.read(1 << 16)
            if not chunk:
                if buffer:
                    return buffer[: len(buffer) - len(buffer) % 2], at + len(buffer), b""
                return None, at, b""
            buffer += chunk


class Utf16Lines(DataSource):
    """``spark.read.format("utf16_lines").option("files", json [[path, size], ...])``: path, start, value."""

    @classmethod
    def name(cls) -> str:
        return "utf16_lines"

    def schema(self) -> str:
        return "path string, start long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader([tuple(f) for f in json.loads(self.options["files"])], int(self.options.get("split", SPLIT_BYTES)))


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    status = fs.getFileStatus(target)
    found = fs.listStatus(target) if status.isDirectory() else [status]
    out = []
    for s in found:
        name = s.getPath().getName()
        if s.isFile() and name[0] not in "._":
            uri = str(s.getPath().toUri())
            out.append((uri[5:] if uri.startswith("file:") else uri, int(s.getLen())))
    return sorted(out)


def utf16_lines(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(path, start, value): every line of the UTF-16 files below ``path``, read in byte ranges."""
    spark.dataSource.register(Utf16Lines)
    return spark.read.format("utf16_lines").option("files", json.dumps(_files(spark, path))).option("split", str(split)).load()


def utf16_records(spark: SparkSession, path: str, split: int = SPLIT_BYTES, quote: str = '"') -> DataFrame:
    """(path, start, record): lines joined into records where a quoted field holds line breaks.

    A line continues the record before it when the quotes before it along its file are odd in
    number. The running count is a distributed prefix sum; a record is gathered from its lines only.
    """
    lines = cut_lineage(utf16_lines(spark, path, split))
    counted = lines.select(
        "path", "start", "value", (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))).cast("long").alias("_q")
    )
    running = prefix_sum(counted, ["start"], {"_upto": "_q"}, ["path"])
    opens = running.withColumn("_opens", F.when((F.col("_upto") - F.col("_q")) % 2 == 0, 1).otherwise(0).cast("long"))
    numbered = prefix_sum(opens, ["start"], {"_record": "_opens"}, ["path"])
    gathered = numbered.groupBy("path", "_record").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("_lines"))
    return gathered.select(
        "path",
        F.col("_lines")[0]["start"].alias("start"),
        F.array_join(F.transform("_lines", lambda l: l["value"]), "\n").alias("record"),
    )


def as_utf8(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> str:
    """A folder of UTF-8 part files holding the records of the UTF-16 files below ``path``.

    Each part starts with the first file's header record and holds whole records, so Spark's CSV
    reader can take the parts in parallel even where quoted fields hold line breaks.
    """
    records = utf16_records(spark, path, split)
    first = records.where(F.col("start") <= 2).orderBy("path").select("record").first()
    header = first["record"] if first else ""

    def headed(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([header], pa.string())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    out = scratch_path(spark, "utf8")
    records.where(F.col("start") > 2).select(F.col("record").alias("value")).mapInArrow(headed, "value string").write.text(out)
    return out
