"""Delimited text with unknown encoding, delimiter and broken lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Candidate delimiters and byte-order marks.
DELIMITERS = [",", ";", "\t", "|"]
BYTE_ORDER_MARKS = [(b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16")]


def _mark(spark: SparkSession, path: str) -> bytes:
    """The first three bytes of the first file below the path, on any file system Spark can reach."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.getFileStatus(target).isDirectory():
        names = sorted(
            str(s.getPath()) for s in fs.listStatus(target) if s.isFile() and s.getPath().getName()[0] not in "._"
        )
        target = jvm.org.apache.hadoop.fs.Path(names[0])
    size = min(3, fs.getFileStatus(target).getLen())
    stream = fs.open(target)
    try:
        return bytes(stream.readNBytes(int(size)))
    finally:
        stream.close()


def detect_encoding(spark: SparkSession, path: str) -> str:
    """By byte-order mark; else UTF-8 if the whole text is valid; else Latin-1."""
    head = _mark(spark, path)
    for mark, name in BYTE_ORDER_MARKS:
        if head.startswith(mark):
            return name
    # One scan answers for the whole text.
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The delimiter that splits the most lines into the same number of fields, then into most fields.

    One aggregation over all lines of all files; ``,`` if none splits any line.
    """
    if encoding.startswith("UTF-16"):
        from statloom.sources.utf16 import utf16_lines

        # a line break is two bytes there: the files are cut into byte ranges at such breaks
        rows = utf16_lines(spark, path).select("value")
    else:
        rows = spark.read.text(path)
    # Quoted text may hold any delimiter.
    bare = rows.where(F.trim("value") != "").select(F.regexp_replace("value", '"[^"]*"', "").alias("value"))
    places = [
        F.struct(F.lit(i).alias("d"), (F.size(F.split("value", "\\Q" + d + "\\E", -1)) - 1).alias("n"))
        for i, d in enumerate(DELIMITERS)
    ]
    usual = bare.select(F.inline(F.array(*places))).groupBy("d", "n").agg(F.count("*").alias("lines")).where("n > 0")
    best = usual.orderBy(F.desc("lines"), F.desc("n"), "d").first()
    return DELIMITERS[best["d"]] if best else ","


def read_robust(
    spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): lines with too many fields go to the quarantine, short lines get nulls.

    UTF-16 files are cut into byte ranges at two-byte line breaks, their records gathered by quote
    parity and written as UTF-8 parts that hold whole records; those parts are read in parallel.
    """
    encoding = encoding or detect_encoding(spark, path)
    delimiter = delimiter or detect_delimiter(spark, path, encoding)
    if encoding.startswith("UTF-16"):
        from statloom.sources.utf16 import as_utf8

        path, encoding = as_utf8(spark, path), "UTF-8-RECORDS"
    base = (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("encoding", "UTF-8" if encoding == "UTF-8-RECORDS" else encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", encoding == "UTF-8-RECORDS")
    )
    # Schema from the header: types are inferred on rows that have the right width.
    head = base.option("inferSchema", True).csv(path)
    names = [f.name.lstrip("﻿") for f in head.schema.fields]
    typed = [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, head.schema.fields)]
    # With column pruning the parser would not see surplus fields.
    rows = base.option("columnPruning", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    read = rows.schema(", ".join([*typed, "_corrupt string"])).csv(path)
    wide = ", ".join([*[f"c{i} string" for i in range(len(names))], "_extra string"])
    extra = F.from_csv("_corrupt", wide, {"sep": delimiter, "quote": '"', "escape": '"'})["_extra"]
    # The reader refuses a query on the corrupt column alone, so the flag touches a data column too.
    touched = F.xxhash64(F.col("`" + names[0] + "`")) >= F.lit(-(2**63))
    flagged = read.withColumn("_long", F.col("_corrupt").isNotNull() & extra.isNotNull() & touched)
    good = flagged.where(~F.col("_long")).drop("_long", "_corrupt")
    return good, flagged.where("_long").select(F.col("_corrupt").alias("line"))
