"""SQL dumps (INSERT statements) as tables.

A dump is cut into pieces at ``;`` + line break by the text source, so a large file is read by many
tasks. Running counts along each file then tell which pieces are COPY data and which belong to one
statement; statements that share a line are split where they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statloom.functions.ordered import prefix_sum
from statloom.session import cut_lineage

# Dump type to Spark type, by the leading word (fixed values).
COLUMN_TYPES = {
    "TINYINT": "smallint", "SMALLINT": "smallint", "MEDIUMINT": "int", "INT": "bigint", "INTEGER": "bigint",
    "BIGINT": "bigint", "SERIAL": "bigint", "BIGSERIAL": "bigint", "DATETIME": "timestamp_ntz",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "DOUBLE": "double", "FLOAT": "double", "REAL": "double",
    "NUMERIC": "double", "DECIMAL": "double", "BOOLEAN": "boolean", "BOOL": "boolean",
}
# Leading words of table lines that are not columns (fixed values).
NOT_COLUMNS = ("PRIMARY", "UNIQUE", "KEY", "INDEX", "CONSTRAINT", "FOREIGN", "FULLTEXT", "CHECK")
NAME = r"(?:[`\"]?\w+[`\"]?\.)?[`\"]?(\w+)[`\"]?"
CREATE = re.compile(rf"(?is)^\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\((.*)\)[^)]*$")
INSERT_PATTERN = r"(?is)^\s*(?:INSERT\s+(?:IGNORE\s+)?|REPLACE\s+)INTO\s"
CREATE_PATTERN = r"(?is)^\s*CREATE\s+TABLE\s"
COPY_PATTERN = r"(?ims)^\s*COPY\s[^;]*\sFROM\s+stdin\s*\z"
COPY_END = r"(?m)^\\\.[ \t\r]*$"


# Rows and characters that a Python step holds at once, beside the one text it reads.
HELD_ROWS, HELD_CHARS = 256, 1_000_000


def _small_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[str]]:
    """The texts of each Arrow batch, made one by one as they are read."""
    for batch in batches:
        yield (text.as_py() for text in batch.column(0))


def _gathered(items: Iterator, size: Callable = len) -> Iterator[list]:
    """Items in lists that end at HELD_ROWS items or HELD_CHARS characters."""
    found, held = [], 0
    for item in items:
        found.append(item)
        held += size(item)
        if len(found) >= HELD_ROWS or held >= HELD_CHARS:
            yield found
            found, held = [], 0
    if found:
        yield found


def clean_statement(c: Column) -> Column:
    """A statement without comments, settings, locks and COPY heads before it; the rest is left alone."""
    head = F.regexp_replace(c, r"(?s)\A(?:\s|--[^\n]*(?:\n|\z)|#[^\n]*(?:\n|\z)|/\*.*?\*/;?)+", "")
    return F.rtrim(F.regexp_replace(head, r"(?is)\A(?:SET|LOCK\s+TABLES|UNLOCK\s+TABLES|DROP\s+TABLE|COPY)\s.*", ""))


def _split(text: str) -> Iterator[str]:
    """Statements of a text at ``;`` outside quotes and line comments; backslash and doubled quotes are honoured."""
    quote, start, i = None, 0, 0
    stops = re.compile(r"""['"`;\\]|--|/\*""")
    while True:
        m = stops.search(text, i)
        if m is None:
            break
        t, i = m.group(), m.end()
        if quote:
            if t == "\\" and quote != "`":
                i += 1
            elif t == quote:
                quote = None
        elif t in "'\"`":
            quote = t
        elif t == ";":
            yield text[start : m.start()]
            start = i
        elif t == "--":
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
        elif t == "/*":
            end = text.find("*/", i)
            i = len(text) if end < 0 else end + 2
    yield text[start:]


def _quotes(text: Column) -> Column:
    """Single quotes in a text, without escaped ones and those of comment lines."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r"(?m)^\s*--[^\n]*$", "")
    return F.length(bare) - F.length(F.replace(bare, F.lit("'")))


def _ordered_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): what lies between two ``;`` + line break, in the order of each file."""
    read = spark.read.option("lineSep", ";\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    # ids rise along a task, and a task reads its blocks from front to back
    return read.select(
        F.col("file_path").alias("file"),
        F.col("file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def _stitched(pieces: DataFrame) -> DataFrame:
    """Pieces without COPY data, and pieces that a quoted value was cut into joined again."""
    order = ["block", "line"]
    begins = F.col("value").rlike(COPY_PATTERN).cast("int")
    ends = F.col("value").rlike(COPY_END).cast("int")
    counted = prefix_sum(pieces.withColumn("ends", ends).withColumn("step", begins - F.col("ends")), order, {"upto": "step"}, ["file"])
    inside = F.col("upto") - F.col("step") > 0
    after = F.regexp_replace("value", r"(?s)\A.*?" + COPY_END + r"\n?", "")
    over = F.col("ends") == 1
    kept = counted.where(~inside | over).withColumn("value", F.when(over, after).otherwise(F.col("value")))
    kept = cut_lineage(kept.select("file", *order, "value", _quotes(F.col("value")).alias("quotes")))
    # a statement is over where the quotes so far are even; the number of such places before a piece names it
    running = prefix_sum(kept, order, {"so_far": "quotes"}, ["file"]).withColumn("over", (F.col("so_far") % 2 == 0).cast("int"))
    named = prefix_sum(running, order, {"closed": "over"}, ["file"])
    return (
        named.groupBy("file", (F.col("closed") - F.col("over")).alias("statement"))
        .agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).alias("parts"))
        .select(F.array_join(F.transform("parts", lambda p: p["value"]), ";\n").alias("value"))
    )


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(statement) rows, cleaned; empty ones dropped.

    COPY blocks are passed over. Text that holds ``;`` + line break inside quotes is put together by
    running counts of quotes along each file, so a file is never read by one task alone.
    """
    pieces = _ordered_pieces(spark, path)
    special = F.col("value").rlike(COPY_PATTERN) | F.col("value").rlike(COPY_END) | (_quotes(F.col("value")) % 2 == 1)
    whole = _stitched(pieces) if pieces.where(special).limit(1).count() else pieces.select("value")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _small_texts(batches):
            for found in _gathered(s for text in texts for s in _split(text)):
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    split = whole.mapInArrow(cut, "value string")
    cleaned = split.select(F.regexp_replace(clean_statement(F.col("value")), r";\s*\z", "").alias("statement"))
    return cleaned.where("statement <> ''")


def _columns(body: str) -> list[tuple[str, str]]:
    """(name, Spark type) of the column lines inside CREATE TABLE (...)."""
    depth, quoted, line, lines = 0, False, "", []
    for ch in body:
        if ch == "'":
            quoted = not quoted
        if not quoted:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                lines.append(line)
                line = ""
                continue
        line += ch
    lines.append(line)
    out = []
    for raw in lines:
        m = re.match(r'\s*[`"]?(\w+)[`"]?\s+(\w+)', raw)
        if m and raw.strip().split()[0].upper() not in NOT_COLUMNS:
            out.append((m.group(1), COLUMN_TYPES.get(m.group(2).upper(), "string")))
    return out


def _radix_literal(radix: str, digits: str) -> str:
    """X'4142' is the text of those bytes (UTF-8, bad bytes replaced); b'101' is the number 5."""
    if radix in "xX":
        return bytes.fromhex(digits if len(digits) % 2 == 0 else "0" + digits).decode("utf-8", errors="replace")
    return str(int(digits, 2)) if digits else "0"


def _tuples(values: str) -> Iterator[list[str | None]]:
    """Value lists of ``(..), (..)``; text without its quotes, NULL as None."""
    token = re.compile(r"""([xXbB])'([0-9A-Fa-f]*)'|'((?:[^'\\]|\\.|'')*)'|([^\s(),']+)|([(),])""", re.S)
    escapes = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
    row: list[str | None] | None = None
    depth = 0
    for m in token.finditer(values):
        radix, digits, text, word, mark = m.groups()
        if radix is not None and row is not None and depth == 1:
            row.append(_radix_literal(radix, digits))
            continue
        if mark == "(":
            depth += 1
            if depth == 1:
                row = []
        elif mark == ")":
            depth -= 1
            if depth == 0 and row is not None:
                yield row
                row = None
        elif row is not None and depth == 1 and mark is None:
            if text is not None:
                row.append(re.sub(r"\\(.)", lambda e: escapes.get(e.group(1), e.group(1)), text.replace("''", "'"), flags=re.S))
            else:
                hexadecimal = re.fullmatch(r"0[xX]([0-9A-Fa-f]+)", word)
                row.append(None if word.upper() == "NULL" else str(int(hexadecimal.group(1), 16)) if hexadecimal else word)


def _read_inserts(texts: Iterator[str]) -> Iterator[tuple[str | None, list[str] | None, list[str | None]]]:
    """(table, names, row) of every value list; a statement that cannot be read is a row without a table."""
    shape = re.compile(rf"(?is)^\s*(?:INSERT\s+(?:IGNORE\s+)?|REPLACE\s+)INTO\s+{NAME}\s*(?:\(([^)]*)\)\s*)?VALUES\s*(.*)$")
    for text in texts:
        m = shape.match(text)
        if not m:
            yield None, None, [text]
            continue
        listed = [c.strip().strip('`"') for c in m.group(2).split(",")] if m.group(2) else None
        for values in _tuples(m.group(3)):
            yield m.group(1), listed, values


def _insert_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _small_texts(batches):
        for found in _gathered(_read_inserts(texts), lambda r: sum(map(len, filter(None, r[2])))):
            tables, names, rows = zip(*found)
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tables, pa.string()), pa.array(names, lists), pa.array(rows, lists)], names=["table", "names", "row"]
            )


def read_dump(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The dump's tables, and ``_failed`` if asked for: (table, reason, failures, example) of what could not be read.

    Failures are INSERT statements that cannot be parsed and rows for tables that the dump does not declare.
    """
    cut = statements(spark, path)
    # One CREATE statement per table.
    schemas: dict[str, list[tuple[str, str]]] = {}
    for r in cut.where(F.col("statement").rlike(CREATE_PATTERN)).collect():
        m = CREATE.match(r["statement"])
        if m:
            schemas[m.group(1)] = _columns(m.group(2))
    rows = cut.where(F.col("statement").rlike(INSERT_PATTERN)).mapInArrow(
        _insert_rows, "table string, names array<string>, row array<string>"
    )
    out: dict[str, DataFrame] = {}
    for name, columns in schemas.items():
        if tables is not None and name not in tables:
            continue
        values = []
        for i, (column, kind) in enumerate(columns):
            place = F.when(F.col("names").isNull(), F.lit(i + 1)).otherwise(F.array_position("names", column))
            cell = F.get("row", place.cast("int") - 1)
            values.append(cell.try_cast(kind).alias(column))
        out[name] = rows.where(F.col("table") == name).select(*values)
    if tables is not None and "_failed" in tables:
        lost = rows.where(F.col("table").isNull() | ~F.col("table").isin([*schemas, ""]))
        reason = F.when(F.col("table").isNull(), "statement").otherwise("undeclared table")
        example = F.when(F.col("table").isNull(), F.col("row")[0])
        out["_failed"] = lost.groupBy("table", reason.alias("reason")).agg(F.count("*").alias("failures"), F.min(example).alias("example"))
    return out
