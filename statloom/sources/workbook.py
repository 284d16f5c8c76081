"""Workbooks (.xlsx) as tables, one file or a folder of files.

A workbook is a zip of XML parts, so one task reads one file; a folder of files is read in parallel.
Every sheet becomes a table; the sheets of the same name in several files are one table.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Built-in date formats of the file format (fixed values).
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
EPOCH = datetime(1899, 12, 30)
ROWS_PER_BATCH = 5000


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _column(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    custom = {
        int(e.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", ""))
        for e in root.iter()
        if _tag(e) == "numFmt"
    }
    dates = DATE_FORMATS | {k for k, v in custom.items() if re.search("[ymdhs]", v, re.I) and "general" not in v.lower()}
    for e in root:
        if _tag(e) == "cellXfs":
            return {i for i, xf in enumerate(e) if int(xf.get("numFmtId", 0)) in dates}
    return set()


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {
        e.get("Id"): e.get("Target") for e in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    }
    out = []
    for e in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter():
        if _tag(e) == "sheet":
            link = next(v for k, v in e.attrib.items() if k.endswith("}id"))
            target = links[link]
            out.append((e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _cells(archive: zipfile.ZipFile, part: str, texts: list[str], dates: set[int]) -> Iterator[tuple[int, list]]:
    with archive.open(part) as stream:
        for _, row in ElementTree.iterparse(stream):
            if _tag(row) != "row":
                continue
            values: list[str | None] = []
            for cell in row:
                at = _column(cell.get("r", "")) if cell.get("r") else len(values)
                values += [None] * (at + 1 - len(values))
                kind = cell.get("t")
                if kind == "inlineStr":
                    values[at] = "".join(e.text or "" for e in cell.iter() if _tag(e) == "t")
                    continue
                raw = next((e.text for e in cell if _tag(e) == "v"), None)
                if raw is None:
                    continue
                if kind == "s":
                    values[at] = texts[int(raw)]
                elif kind == "b":
                    values[at] = "true" if raw == "1" else "false"
                elif kind is None and int(cell.get("s", 0)) in dates:
                    values[at] = (EPOCH + timedelta(seconds=round(float(raw) * 86400))).isoformat(sep=" ")
                else:
                    values[at] = raw
            yield int(row.get("r", 0)), values
            row.clear()


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        for file, content in zip(part["path"], part["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                texts: list[str] = []
                if "xl/sharedStrings.xml" in archive.namelist():
                    for e in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")):
                        texts.append("".join(t.text or "" for t in e.iter() if _tag(t) == "t"))
                dates = _date_styles(archive)
                for sheet, target in _sheets(archive):
                    batch: list[tuple] = []
                    first = True
                    for number, values in _cells(archive, target, texts, dates):
                        if not any(v is not None for v in values):
                            continue
                        batch.append((file, sheet, number, first, values))
                        first = False
                        if len(batch) >= ROWS_PER_BATCH:
                            yield pd.DataFrame(batch, columns=["file", "sheet", "row", "is_header", "values"])
                            batch = []
                    if batch:
                        yield pd.DataFrame(batch, columns=["file", "sheet", "row", "is_header", "values"])


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, is_header, values) of every sheet."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path)
    # The reader packs small files together; one task per file keeps large ones apart.
    return files.select("path", "content").mapInPandas(
        _read, "file string, sheet string, row int, is_header boolean, values array<string>"
    )


def _typed(cells: DataFrame, names: list[str]) -> DataFrame:
    """Each column as bigint, double, timestamp or boolean where all present values allow it."""
    kinds = ["bigint", "double", "timestamp_ntz", "boolean"]
    facts = []
    for i in range(len(names)):
        v = F.get("values", F.lit(i))
        facts += [F.bool_and(v.try_cast(k).isNotNull() | v.isNull()) & F.bool_or(v.isNotNull()) for k in kinds]
    row = cells.agg(*[f.alias(f"f{j}") for j, f in enumerate(facts)]).first()
    out = []
    for i, name in enumerate(names):
        flags = row[i * len(kinds) : (i + 1) * len(kinds)]
        kind = next((k for k, ok in zip(kinds, flags) if ok), "string")
        out.append(F.get("values", F.lit(i)).try_cast(kind).alias(name))
    return cells.select(*out)


def read_workbooks(spark: SparkSession, path: str, sheets: list[str] | None = None) -> dict[str, DataFrame]:
    """A table per sheet that holds rows below its header; header names are stripped."""
    rows = workbook_rows(spark, path)
    # A header row per sheet and file.
    headers = (
        rows.where("is_header").groupBy("sheet").agg(F.max_by("values", F.size("values")).alias("names")).collect()
    )
    filled = {r["sheet"] for r in rows.where("not is_header").select("sheet").distinct().collect()}
    out = {}
    for r in sorted(headers, key=lambda r: r["sheet"]):
        if r["sheet"] not in filled or (sheets is not None and r["sheet"] not in sheets):
            continue
        names = [(n or f"column_{i + 1}").strip() for i, n in enumerate(r["names"])]
        body = rows.where((F.col("sheet") == r["sheet"]) & ~F.col("is_header"))
        out[r["sheet"]] = _typed(body, names)
    return out
