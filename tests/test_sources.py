import sqlite3
from pathlib import Path

import pandas as pd
import pytest

from checks.workflow import _workbook
from statloom.operators.relational import analysis_targets, merge_tables, run_query
from statloom.sources import delimited, dump, files
from statloom.sources.files import catalog_summary, read_source


def test_utf16_file(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_bytes("a,b\n1,2\n".encode("utf-16"))
    rows, bad = delimited.read_robust(spark, str(path))
    assert [tuple(r) for r in rows.collect()] == [(1, 2)] and bad.count() == 0


def test_latin1_and_semicolons(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("name;n\ncafé;1\n\"a;b\";2\n".encode("latin-1"))
    assert delimited.detect_encoding(spark, str(path)) == "ISO-8859-1"
    rows, _ = delimited.read_robust(spark, str(path))
    assert sorted(tuple(r) for r in rows.collect()) == [("a;b", 2), ("café", 1)]


def test_long_lines_are_kept_apart_and_short_ones_filled(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    rows, bad = delimited.read_robust(spark, str(path))
    assert sorted(((r["a"], r["b"], r["c"]) for r in rows.collect()), key=str) == [(1, 2, 3), (4, 5, None)]
    assert [r["line"] for r in bad.collect()] == ["6,7,8,9"]


@pytest.mark.parametrize("mark", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, mark):
    path = tmp_path / "d.txt"
    path.write_text("\n".join(mark.join(r) for r in (["x", "y", "z"], ["1", "2", "3"], ["4", "5", "6"], [])))
    assert delimited.detect_delimiter(spark, str(path)) == mark


def test_tsv_by_extension(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("a\tb\n1\tx\n")
    assert [tuple(r) for r in read_source(spark, str(path))["t"].collect()] == [(1, "x")]
    with pytest.raises(ValueError):
        read_source(spark, "t.unknown")


def test_sqlite_tables_and_query(spark, tmp_path):
    path = tmp_path / "shop.db"
    con = sqlite3.connect(path)
    con.executescript(
        "CREATE TABLE c (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE o (cid INTEGER, total REAL);"
        "INSERT INTO c VALUES (1, 'ann'), (2, NULL); INSERT INTO o VALUES (1, 2.5), (1, 3.5), (2, 1.0);"
        "CREATE TABLE w (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID; INSERT INTO w VALUES ('x', 7);"
    )
    con.commit()
    con.close()
    before = path.read_bytes()
    tables = read_source(spark, str(path))
    assert sorted(tables) == ["c", "o", "w"] and tables["w"].first()["v"] == 7
    got = run_query(spark, tables, "SELECT name, sum(total) AS t FROM c JOIN o ON c.id = o.cid GROUP BY name")
    assert {(r["name"], r["t"]) for r in got.collect()} == {("ann", 6.0), (None, 1.0)}
    assert list(read_source(spark, str(path), ["o"])) == ["o"] and path.read_bytes() == before


DUMP = r"""-- MySQL dump
/*!40101 SET NAMES utf8 */;
SET TIME_ZONE='+00:00';
DROP TABLE IF EXISTS `item`;
CREATE TABLE `item` (
  `id` int(11) unsigned NOT NULL AUTO_INCREMENT,
  `label` varchar(40) DEFAULT 'a,b',
  `price` decimal(10,2),
  `made` datetime,
  `kind` enum('x','y'),
  PRIMARY KEY (`id`)
) ENGINE=InnoDB DEFAULT CHARSET=utf8;
LOCK TABLES `item` WRITE;
INSERT INTO `item` VALUES (1,'it''s (one), INT',2.50,'2024-01-02 03:04:05','x'),(2,'semi; colon',NULL,NULL,'y');
INSERT INTO item (label, id) VALUES ('back\'slash', 3);
INSERT INTO nonsense;
UNLOCK TABLES;
"""


@pytest.mark.parametrize("tail", ["", "INSERT INTO item (id, label) VALUES (4, 'cut;\nhere');\n"])
def test_sql_dump(spark, tmp_path, tail):
    path = tmp_path / "shop.sql"
    path.write_text(DUMP + tail)
    item = read_source(spark, str(path))["item"]
    assert item.dtypes == [("id", "bigint"), ("label", "string"), ("price", "double"), ("made", "timestamp_ntz"), ("kind", "string")]
    rows = {r["id"]: r for r in item.collect()}
    assert rows[1]["label"] == "it's (one), INT" and rows[1]["price"] == 2.5 and rows[1]["made"].hour == 3
    assert rows[2]["label"] == "semi; colon" and rows[2]["price"] is None
    assert rows[3]["label"] == "back'slash" and rows[3]["kind"] is None
    assert (4 in rows) == bool(tail)
    if tail:
        assert rows[4]["label"] == "cut;\nhere"
    failed = dump.read_dump(spark, str(path), ["_failed"])["_failed"].collect()
    assert [(r.table, r.reason, r.failures, r.example) for r in failed] == [(None, "statement", 1, "INSERT INTO nonsense")]


def test_dump_with_copy_block_and_undeclared_table(spark, tmp_path):
    path = tmp_path / "pg.sql"
    path.write_text(
        "CREATE TABLE a (id int, v text);\nCOPY public.a (id, v) FROM stdin;\n1\tit's;\n2\tb;\nINSERT INTO a VALUES (9, 'data');\n\\.\n\n"
        "INSERT INTO a VALUES (3, 'x;\ny'); INSERT INTO a VALUES (4, 'z');\nINSERT INTO b VALUES (1), (2);\nINSERT INTO a VALUES (5, NULL);\n"
    )
    tables = dump.read_dump(spark, str(path))
    assert sorted((r.id, r.v) for r in tables["a"].collect()) == [(3, "x;\ny"), (4, "z"), (5, None)]
    failed = dump.read_dump(spark, str(path), ["_failed"])["_failed"].collect()
    assert [(r.table, r.reason, r.failures) for r in failed] == [("b", "undeclared table", 2)]


def test_workbooks(spark, tmp_path):
    for i in range(2):
        Path(tmp_path / f"b{i}.xlsx").write_bytes(_workbook(pd.DataFrame({"id": [i * 2, i * 2 + 1], " name ": ["a<b", "c"]})))
    table = read_source(spark, str(tmp_path / "b0.xlsx"))["parts"]
    assert table.dtypes == [("id", "bigint"), ("name", "string")]
    from statloom.sources.workbook import read_workbooks

    both = read_workbooks(spark, str(tmp_path))["parts"]
    assert sorted(tuple(r) for r in both.collect()) == [(0, "a<b"), (1, "c"), (2, "a<b"), (3, "c")]


def test_merge_and_targets(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("q",)], "y string")
    merged = merge_tables({"a": a, "b": b})
    assert merged.columns == ["__source__", "x", "y"] and merged.count() == 2
    assert merge_tables({"a": a}).columns == ["x"]
    assert list(analysis_targets({"a": a, "b": b}, "auto")) == ["__merged__", "a", "b"]
    wide = spark.createDataFrame([tuple(range(10))], [f"c{i}" for i in range(10)])
    rows = catalog_summary({"wide": wide}).collect()
    assert len(rows) == 8 and {r["more"] for r in rows} == {2} and files.catalog_summary is catalog_summary


def test_utf16_in_byte_ranges_with_quoted_line_breaks(spark, tmp_path):
    import csv
    import io

    from statloom.sources.delimited import read_robust
    from statloom.sources.utf16 import utf16_lines, utf16_records

    rows = [["id", "name", "note"]] + [[str(i), f"n{i}", f'one {i}\ntwo "q"' if i % 7 == 0 else f"é {i}"] for i in range(2000)]
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\r\n").writerows(rows)
    path = tmp_path / "wide.csv"
    path.write_bytes(buffer.getvalue().encode("utf-16"))
    assert utf16_lines(spark, str(path), split=4096).rdd.getNumPartitions() > 10
    records = [r["record"] for r in utf16_records(spark, str(path), split=4096).orderBy("start").collect()]
    assert len(records) == len(rows) and records[8].startswith('7,n7,"one 7\ntwo ""q"""')
    good, bad = read_robust(spark, str(path))
    got = sorted((r["id"], r["name"], r["note"]) for r in good.collect())
    assert got == sorted((int(a), b, c) for a, b, c in rows[1:]) and bad.count() == 0


def test_dump_hex_bit_literals_and_replace(spark, tmp_path):
    path = tmp_path / "lit.sql"
    path.write_text(
        "CREATE TABLE t (id int, label varchar(10), flags int, code int);\n"
        "INSERT INTO t VALUES (1, X'4142', b'101', 0x1F), (2, x'', B'0', 7);\n"
        "REPLACE INTO t VALUES (3, 'c', 1, 2);\n"
    )
    rows = sorted(tuple(r) for r in dump.read_dump(spark, str(path))["t"].collect())
    assert rows == [(1, "AB", 5, 31), (2, "", 0, 7), (3, "c", 1, 2)]


def test_dump_steps_hold_few_rows_at_once():
    import pyarrow as pa

    many = "INSERT INTO t VALUES " + ", ".join(f"({i}, 'x')" for i in range(5_000))
    wide = [f"INSERT INTO t VALUES ({i}, '{'y' * 300_000}')" for i in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array([many, *wide, "INSERT INTO t VALUE"])], names=["statement"])
    parts = list(dump._insert_rows(iter([batch])))
    rows = [r for part in parts for r in part.column(2).to_pylist()]
    assert len(rows) == 5_009 and rows[4_999] == ["4999", "x"] and rows[-1] == ["INSERT INTO t VALUE"]
    assert max(part.num_rows for part in parts) <= dump.HELD_ROWS
    assert max(sum(len(c or "") for r in part.column(2).to_pylist() for c in r) for part in parts) < dump.HELD_CHARS + 400_000


def test_dump_has_a_file_for_each_split(spark, tmp_path):
    from checks import workflow

    docs = spark.range(900).selectExpr("id AS doc_id", "concat('a;', id) AS text", "'en' AS lang", "2L AS n_chars")
    docs.repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    path = workflow._dump(spark, str(tmp_path))
    assert len(spark.read.text(path).inputFiles()) > 4
    assert workflow.dump_statements(spark, str(tmp_path)).first()["statements"] == 900
    assert workflow.dump_source(spark, str(tmp_path)).count() == 900
