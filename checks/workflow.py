"""Registered queries: sources, sinks, validation, guardrails, confidence, batch runs, DBSCAN, layouts."""

from __future__ import annotations

import io
import os
import sqlite3
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from checks.support import rounded, table
from checks.tables import _describe_sql
from statloom.functions.ordered import weighted_quantiles
from statloom.operators import dbscan, layout
from statloom.operators.cluster import standardised
from statloom.plans import batch, catalogue, confidence, guardrails, results, validation
from statloom.session import cut_lineage, scratch_path
from statloom.sources import delimited, dump, files, sqlite, workbook

# --- sources: Spark writes the tables in the foreign format, then reads them back -----------------


def csv_source(spark, sf):
    path = scratch_path(spark, "customer") + ".csv"
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return rounded(next(iter(files.read_source(spark, path).values())))


def tsv_source(spark, sf):
    path = scratch_path(spark, "nation") + ".tsv"
    table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag").write.option(
        "header", True
    ).option("sep", "\t").csv(path)
    df = next(iter(files.read_source(spark, path).values()))
    return df.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def robust_csv(spark, sf):
    """Semicolons, and one field too many on every line with a negative balance."""
    path = scratch_path(spark, "robust")
    line = F.concat_ws(";", "c_custkey", "c_name", F.format_string("%.2f", "c_acctbal"))
    body = table(spark, sf, "customer").select(F.when(F.col("c_acctbal") < 0, F.concat(line, F.lit(";surplus"))).otherwise(line).alias("value"))
    # Every part file of a CSV folder starts with the header.
    parts = body.repartition(4).mapInPandas(_with_header("custkey;name;balance"), "value string")
    parts.write.text(path)
    good, bad = delimited.read_robust(spark, path)
    return good.agg(F.count("*").alias("rows"), F.round(F.sum("balance"), 2).alias("balance")).withColumn(
        "quarantined", bad.agg(F.count("*")).scalar()
    )


def _with_header(header: str):
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [header]})
        yield from batches

    return add


def delimiter(spark, sf):
    path = scratch_path(spark, "pipes")
    table(spark, sf, "supplier").write.option("header", True).option("sep", "|").csv(path)
    return spark.createDataFrame([(delimited.detect_delimiter(spark, path), delimited.detect_encoding(spark, path))], "delimiter string, encoding string")


def _sqlite_shard(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = os.path.join(folder, f"shard-{TaskContext.get().partitionId():05d}-{TaskContext.get().attemptNumber()}.db")
        con = sqlite3.connect(name)
        con.execute("CREATE TABLE IF NOT EXISTS orders (orderkey INTEGER, status TEXT, price REAL)")
        total = 0
        for part in batches:
            con.executemany("INSERT INTO orders VALUES (?, ?, ?)", part.itertuples(index=False, name=None))
            total += len(part)
        con.commit()
        con.close()
        yield pd.DataFrame({"file": [name], "rows": [total]})

    return write


def sqlite_source(spark, sf):
    """Every task writes one database file; the source reads the folder in parallel."""
    folder = scratch_path(spark, "sqlite").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").repartition(4)
    rows.mapInPandas(_sqlite_shard(folder), "file string, rows long").collect()
    orders = sqlite.read_sqlite(spark, folder)["orders"]
    return orders.groupBy("status").agg(
        F.count("*").alias("rows"), F.sum("orderkey").alias("key_sum"), F.round(F.sum("price"), 2).alias("price")
    )


def _dump(spark, sf) -> str:
    """A dump of the documents, whose texts hold quotes, line breaks and semicolons."""
    path = scratch_path(spark, "dump")
    value = F.regexp_replace(F.regexp_replace("text", r"\\", r"\\\\\\\\"), "'", "''")
    insert = F.concat(
        F.lit("INSERT INTO `documents` VALUES ("), F.col("doc_id"), F.lit(",'"), value, F.lit("','"), F.col("lang"), F.lit("',"), F.col("n_chars"), F.lit(");")
    )
    head = "-- dump\nSET NAMES utf8;\nCREATE TABLE `documents` (\n  `doc_id` bigint unsigned NOT NULL,\n  `text` longtext,\n  `lang` enum('en','fr') DEFAULT 'en',\n  `n_chars` int(11),\n  PRIMARY KEY (`doc_id`)\n) ENGINE=InnoDB DEFAULT CHARSET=utf8;\n"
    # a file for each split of the table, and four at least
    lines = table(spark, sf, "documents").select(insert.alias("value"))
    if lines.rdd.getNumPartitions() < 4:
        lines = lines.repartition(4)
    lines.mapInPandas(_with_header(head), "value string").write.text(path)
    return path


def dump_source(spark, sf):
    docs = dump.read_dump(spark, _dump(spark, sf))["documents"]
    return docs.select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")


def dump_failures(spark, sf):
    """A dump of suppliers for a table that it does not declare, with a broken statement a nation."""
    path = scratch_path(spark, "failures")
    rows = table(spark, sf, "supplier").select(F.format_string("INSERT INTO undeclared VALUES (%d);", "s_suppkey").alias("value"))
    broken = table(spark, sf, "nation").select(F.format_string("INSERT INTO broken %d;", "n_nationkey").alias("value"))
    declared = spark.createDataFrame([("CREATE TABLE declared (id int);",)], "value string")
    declared.unionAll(rows).unionAll(broken).write.text(path)
    return dump.read_dump(spark, path, ["_failed"])["_failed"].drop("example")


def dump_statements(spark, sf):
    rows = dump.statements(spark, _dump(spark, sf))
    return rows.groupBy(F.upper(F.substring("statement", 1, 12)).alias("kind")).agg(F.count("*").alias("statements")).where(
        "kind = 'INSERT INTO '"
    )


def _workbook(rows: pd.DataFrame) -> bytes:
    def cell(v) -> str:
        return f"<c><v>{v!r}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    lines = [list(rows.columns), *rows.itertuples(index=False, name=None)]
    sheet = "".join(f'<row r="{i}">{"".join(cell(v) for v in line)}</row>' for i, line in enumerate(lines, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="parts" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def _workbook_writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i, part in enumerate(batches):
            name = os.path.join(folder, f"book-{TaskContext.get().partitionId():05d}-{i}.xlsx")
            with open(name, "wb") as f:
                f.write(_workbook(part))
            yield pd.DataFrame({"file": [name], "rows": [len(part)]})

    return write


def workbook_source(spark, sf):
    folder = scratch_path(spark, "books").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice").repartition(4)
    parts.mapInPandas(_workbook_writer(folder), "file string, rows long").collect()
    return rounded(workbook.read_workbooks(spark, folder)["parts"])


# --- sinks, validation, guardrails, confidence ---------------------------------------------------


def written_results(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    outcome = catalogue.run_analysis(df, "descriptive_stats")
    path = scratch_path(spark, "results")
    results.write_results([outcome], path)
    return rounded(spark.read.parquet(f"{path}/analysis_id=descriptive_stats/describe"), 4)


def detail_table(spark, sf):
    df = table(spark, sf, "customer").select("c_mktsegment", "c_acctbal")
    return rounded(results.detail_table(catalogue.run_analysis(df, "pareto")), 4, value=2)


def validate_all(spark, sf):
    return validation.validate_all(table(spark, sf, "orders"), {"group_column": "o_orderstatus"}).select("analysis_id", "status")


def validate_labels(spark, sf):
    return validation.validate_all(table(spark, sf, "labels")).select("analysis_id", "status")


def _checks(df, analysis_id, params):
    return guardrails.check_assumptions(df, analysis_id, params).drop("message")


def guard_logistic(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id", "left").select("quality", "n_chars")
    rare = df.withColumn("rare", (F.col("n_chars") > 10000).cast("int"))
    return rounded(_checks(rare, "regression_logistic", {"target_column": "rare"}))


def guard_kmeans(spark, sf):
    return rounded(_checks(table(spark, sf, "lineitem"), "clustering_kmeans", {"features": ["l_quantity", "l_extendedprice", "l_tax"]}), 1)


def guard_series(spark, sf):
    return rounded(_checks(table(spark, sf, "events"), "time_series_arima", {"date_col": "ts"}))


def guard_linear(spark, sf):
    return rounded(_checks(table(spark, sf, "lineitem"), "regression_linear", {"target": "l_extendedprice", "features": ["l_quantity", "l_discount"]}), 4)


def guard_anova(spark, sf):
    return rounded(_checks(table(spark, sf, "customer"), "anova", {"groupby": "c_mktsegment", "target": "c_acctbal"}), 4)


def guard_correlation(spark, sf):
    return rounded(_checks(table(spark, sf, "part"), "correlation", {"features": ["p_size", "p_retailprice"]}), 4)


def guard_summary(spark, sf):
    checks = guardrails.check_assumptions(table(spark, sf, "lineitem"), "clustering_kmeans", {"features": ["l_quantity", "l_extendedprice"]})
    return guardrails.guardrail_summary(checks, "clustering_kmeans").select("analysis_id", "passed", "failed")


def quality_sheet(spark, sf):
    events = guardrails.check_assumptions(table(spark, sf, "events"), "time_series_arima", {"date_col": "ts"})
    lines = guardrails.check_assumptions(table(spark, sf, "lineitem"), "clustering_kmeans", {"features": ["l_quantity", "l_extendedprice"]})
    sheet = results.quality_sheet(results.combine_checks({"time_series_arima": events, "clustering_kmeans": lines}))
    return sheet.select("analysis_id", "status")


def confidence_scores(spark, sf):
    """Brands as results: their rows, share of large parts, sizes as failed checks, prices as fits."""
    facts = (
        table(spark, sf, "part")
        .groupBy("p_brand")
        .agg(
            F.count("*").alias("rows"),
            F.avg((F.col("p_size") > 25).cast("double")).alias("missing_share"),
            (F.min("p_size") + 1).cast("long").alias("failed"),
            (F.max("p_retailprice") / 2000).alias("r2"),
            (F.min("p_retailprice") / 3100).alias("silhouette"),
        )
    )
    scored = confidence.confidence(facts)
    return rounded(scored.select("p_brand", "score", F.size("reasons").alias("reasons")), 2)


def key_findings(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("position"),
        F.col("o_orderpriority").alias("analysis_name"),
        F.lit("").alias("interpretation"),
        F.expr(
            "array(named_struct('metric', 'status', 'value', o_orderstatus), named_struct('metric', 'customer', 'value', string(o_custkey)),"
            " named_struct('metric', 'key', 'value', string(o_orderkey)), named_struct('metric', 'more', 'value', 'x'))"
        ).alias("summary"),
    )
    return results.key_findings(rows)


def results_log(spark, sf):
    """Sessions for three tables; one is deleted; the rest is listed with its headline numbers."""
    log = results.ResultsLog(spark, scratch_path(spark, "log"))
    kept = []
    for name in ("customer", "supplier", "nation"):
        df = table(spark, sf, name)
        session = log.create_session(f"{name}.parquet", df.count(), len(df.columns))
        log.save_result(session, catalogue.run_analysis(df, "descriptive_stats"))
        kept.append(session)
    log.delete_session(kept[1])
    parts = [log.results(s).select("analysis_id", "success", F.filter("summary", lambda m: m["metric"] == "rows")[0]["value"].cast("long").alias("rows")) for s in kept]
    return reduce(DataFrame.unionByName, parts)


def batch_scores(spark, sf):
    steps = [("descriptive_stats", {}), ("anova", {"group_column": "c_mktsegment", "target_column": "c_acctbal"}), ("unknown", {}), ("pareto", {})]
    df = table(spark, sf, "customer").select("c_acctbal", "c_mktsegment", "c_nationkey")
    return rounded(batch.run_batch(df, steps).scores.select("analysis_id", "rows", "missing_share"))


# --- DBSCAN and layouts --------------------------------------------------------------------------

PART = ["p_size", "p_retailprice"]


def _part_points(spark, sf):
    rows = standardised(table(spark, sf, "part"), PART, ["p_partkey"]).withColumnRenamed("p_partkey", "key")
    return cut_lineage(dbscan.distinct_points(rows))


def dbscan_eps(spark, sf):
    points = _part_points(spark, sf)
    return spark.createDataFrame([(round(dbscan.choose_eps(points, 2), 6),)], "eps double")


def neighbor_distances(spark, sf):
    kd = dbscan.neighbor_distances(_part_points(spark, sf), 2, 5)
    return rounded(weighted_quantiles(kd.groupBy("kd").agg(F.sum("w").alias("n")), "kd", {"p10": 0.1, "p50": 0.5, "p100": 1.0}).drop("_n"))


def dbscan_metrics(spark, sf):
    out = dbscan.dbscan(table(spark, sf, "part"), PART, "p_partkey", eps=0.15)["metrics"]
    return rounded(out)


def dbscan_sizes(spark, sf):
    return rounded(dbscan.dbscan(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], "c_custkey")["sizes"])


def _layout(weighting):
    def run(spark, sf):
        df = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
        return rounded(layout.neighbor_layout_2d(df, [f"e{i}" for i in range(64)], "vec_id", weighting), 4)

    return run


QUERIES = {
    "source_csv": csv_source,
    "source_tsv": tsv_source,
    "source_csv_robust": robust_csv,
    "source_delimiter": delimiter,
    "source_sqlite": sqlite_source,
    "source_sql_dump": dump_source,
    "source_dump_statements": dump_statements,
    "source_dump_failures": dump_failures,
    "source_workbook": workbook_source,
    "sink_results": written_results,
    "sink_detail_table": detail_table,
    "validate_all": validate_all,
    "validate_all_labels": validate_labels,
    "guardrail_logistic": guard_logistic,
    "guardrail_kmeans": guard_kmeans,
    "guardrail_series": guard_series,
    "guardrail_linear": guard_linear,
    "guardrail_anova": guard_anova,
    "guardrail_correlation": guard_correlation,
    "guardrail_summary": guard_summary,
    "quality_sheet": quality_sheet,
    "confidence_scores": confidence_scores,
    "key_findings": key_findings,
    "results_log": results_log,
    "batch_scores": batch_scores,
    "dbscan_eps": dbscan_eps,
    "dbscan_neighbor_distances": neighbor_distances,
    "dbscan_metrics": dbscan_metrics,
    "dbscan_sizes": dbscan_sizes,
    "layout_uniform": _layout("uniform"),
    "layout_perplexity": _layout("perplexity"),
}

IDS = [i for i, _, _ in catalogue.METHODS]


def _validate_sql(source: str, facts: str) -> str:
    """Statuses from the table's own facts; the conditions are written per analysis."""
    least = " UNION ALL ".join(f"SELECT '{i}' AS analysis_id, {rows} AS least" for i, _, rows in catalogue.METHODS)
    series = "('time_series_arima', 'time_series_prophet', 'granger_causality')"
    numbers = "('regression_linear', 'regression_polynomial', 'pca', 'tsne', 'umap', 'clustering_kmeans', 'clustering_dbscan', 'clustering_hierarchical', 'anomaly_isolation_forest', 'anomaly_zscore', 'correlation')"
    return f"""WITH m AS ({least}), f AS ({facts})
SELECT analysis_id, CASE WHEN n < least THEN 'blocked' WHEN analysis_id IN {series} AND (dates = 0 OR nums < 1) THEN 'blocked'
 WHEN analysis_id = 'regression_logistic' AND NOT two THEN 'blocked' WHEN analysis_id = 'survival_kaplan_meier' AND NOT durations THEN 'blocked'
 WHEN analysis_id = 'market_basket' THEN 'blocked' WHEN analysis_id = 'cohort' AND NOT users THEN 'blocked'
 WHEN analysis_id IN ('ttest', 'mann_whitney') AND levels > 2 THEN 'preprocess'
 WHEN analysis_id IN {numbers} AND nums < 2 THEN 'blocked' WHEN analysis_id IN ('pca', 'tsne', 'umap') AND nums < 3 THEN 'blocked'
 WHEN analysis_id = 'chi_square' AND cats < 2 THEN 'blocked' WHEN analysis_id = 'anova' AND NOT three THEN 'blocked'
 WHEN n < 100 THEN 'warning' WHEN analysis_id LIKE 'clustering%' AND n < 200 THEN 'warning' ELSE 'ok' END AS status FROM m, f"""


PART_Z = """z AS (SELECT p_partkey AS id, (p_size - avg(p_size) OVER ())/stddev_pop(p_size) OVER () AS x,
 (p_retailprice - avg(p_retailprice) OVER ())/stddev_pop(p_retailprice) OVER () AS y FROM part)"""
KD_SQL = f"""WITH {PART_Z}, r AS (SELECT a.id, sqrt(power(a.x-b.x, 2) + power(a.y-b.y, 2)) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY power(a.x-b.x, 2) + power(a.y-b.y, 2)) AS k FROM z a, z b),
kd AS (SELECT dist AS kd FROM r WHERE k = 5)"""

def _poly_sql(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _quantile_sql(p: str) -> str:
    """The normal quantile by the same rational approximation as the operator."""
    from statloom.functions.special import QUANTILE_A, QUANTILE_B, QUANTILE_C, QUANTILE_D

    r, q = f"(({p} - 0.5) * ({p} - 0.5))", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    middle = f"({_poly_sql(QUANTILE_A, r)} * ({p} - 0.5) / {_poly_sql(QUANTILE_B, r)})"
    tail = f"({_poly_sql(QUANTILE_C, q)} / {_poly_sql(QUANTILE_D, q)})"
    return f"(CASE WHEN {p} < 0.02425 THEN {tail} WHEN {p} > 0.97575 THEN -{tail} ELSE {middle} END)"


def _upper_sql(z: str) -> str:
    """P(Z > z) by the erfc fit."""
    from statloom.functions.special import ERFC_FIT

    a = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.5 * {a}))"
    poly = repr(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        poly = f"({poly} * {t} + {c!r})"
    tail = f"(0.5 * {t} * exp(-{a} * {a} + {poly}))"
    return f"(CASE WHEN {z} > 0 THEN {tail} ELSE 1 - {tail} END)"


def _shapiro_francia_sql(table_name: str, columns: list[str], by: tuple[str, str] | None = None) -> str:
    """Per column, or per group ``by`` = (group, value) of at least five rows: W' and p, unrounded p kept."""
    from statloom.plans.guardrails import ALPHA, LOG_MEAN, LOG_SPREAD

    if by:
        group, value = by
        values = (
            f"SELECT {group}::VARCHAR AS col, {value}::DOUBLE AS v FROM {table_name} WHERE {value} IS NOT NULL AND {group} IN "
            f"(SELECT {group} FROM {table_name} WHERE {group} IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)"
        )
    else:
        values = " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::DOUBLE AS v FROM {table_name} WHERE {c} IS NOT NULL" for c in columns)
    p = "((rk - 0.375) / (n + 0.25))"
    return f"""WITH v AS ({values}),
r AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) AS rk, count(*) OVER (PARTITION BY col) AS n FROM v),
m AS (SELECT col, v, n, {_quantile_sql(p)} AS m FROM r),
w AS (SELECT col, max(n) AS n, covar_pop(v, m) AS vm, var_pop(v) AS vv, var_pop(m) AS mm FROM m GROUP BY col),
ws AS (SELECT *, least(coalesce(vm * vm / nullif(vv * mm, 0), 1.0), 1.0) AS w_stat FROM w),
z AS (SELECT *, (ln(greatest(1 - w_stat, 1e-300)) - ({LOG_MEAN[0]} + {LOG_MEAN[1]} * (ln(ln(n)) - ln(n))))
  / ({LOG_SPREAD[0]} + {LOG_SPREAD[1]} * (ln(ln(n)) + 2 / ln(n))) AS z FROM ws),
pv AS (SELECT *, CASE WHEN n >= 5 AND w_stat < 1 THEN {_upper_sql('z')} ELSE 1.0 END AS p FROM z)
SELECT 'shapiro_francia' AS test, col AS "column", round(w_stat, 4) + 0.0 AS stat, {"p" if by else "round(p, 4) + 0.0"} AS p_value, p >= {ALPHA} AS passed FROM pv"""


def _anova_guard_sql() -> str:
    """Groups of five rows or more whose Shapiro-Francia p is below ALPHA, and Levene's test, as the checks report them."""
    from checks.statistics import ORACLES as STATISTICS
    from statloom.plans.guardrails import ALPHA

    levene = STATISTICS["levene"].replace(
        "SELECT k AS groups, round(f, 6) AS w_stat, round(p, 6) AS p_value FROM w, f0, ft", "SELECT k AS groups, f AS w_stat, p AS p_value FROM w, f0, ft"
    )
    groups = _shapiro_francia_sql("customer", [], by=("c_mktsegment", "c_acctbal"))
    return f"""SELECT 'shapiro_francia' AS test, 'c_acctbal' AS "column", bad::DOUBLE AS stat, NULL::DOUBLE AS p_value, false AS passed
FROM (SELECT count(*) AS k, count(*) FILTER (WHERE p_value < {ALPHA}) AS bad FROM ({groups}) sf) t WHERE k >= 2 AND bad > 0
UNION ALL
SELECT 'levene', 'c_acctbal', round(w_stat, 4) + 0.0, round(p_value, 4) + 0.0, p_value >= {ALPHA} FROM ({levene}) lv WHERE groups >= 2 AND p_value IS NOT NULL"""


def _linear_guard_sql() -> str:
    """Normality of the target, VIF without a constant above the limit, and the rows per feature."""
    from statloom.plans.guardrails import ROWS_PER_FEATURE, VIF_LIMIT

    sf = _shapiro_francia_sql("lineitem", ["l_extendedprice"])
    return f"""{sf}
UNION ALL
SELECT 'vif', c, round(round(vif, 2), 4) + 0.0, NULL::DOUBLE, false FROM (
  SELECT unnest(['l_quantity', 'l_discount']) AS c, 1 / (1 - power(sum(l_quantity * l_discount) / sqrt(sum(l_quantity * l_quantity) * sum(l_discount * l_discount)), 2)) AS vif
  FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL) WHERE vif > {VIF_LIMIT}
UNION ALL
SELECT 'sample_size', 'l_extendedprice', n::DOUBLE, NULL::DOUBLE, false FROM (SELECT count(l_extendedprice) AS n FROM lineitem) WHERE n < {2 * ROWS_PER_FEATURE}"""


ORACLES = {
    "guardrail_linear": _linear_guard_sql(),
    "guardrail_anova": _anova_guard_sql(),
    "guardrail_correlation": _shapiro_francia_sql("part", ["p_size", "p_retailprice"]),
    "source_csv": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer",
    "source_tsv": "SELECT l_returnflag, count(*) AS rows, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1",
    "source_csv_robust": """SELECT count(*) FILTER (c_acctbal >= 0) AS rows, round(sum(round(c_acctbal, 2)) FILTER (c_acctbal >= 0), 2) AS balance,
 count(*) FILTER (c_acctbal < 0) AS quarantined FROM customer""",
    "source_sqlite": "SELECT o_orderstatus AS status, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1",
    "source_delimiter": "SELECT CASE WHEN count(*) > 0 THEN '|' ELSE ',' END AS delimiter, 'UTF-8' AS encoding FROM supplier",
    "source_dump_failures": """SELECT 'undeclared' AS "table", 'undeclared table' AS reason, count(*) AS failures FROM supplier
 UNION ALL SELECT NULL, 'statement', count(*) FROM nation""",
    "source_sql_dump": "SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents",
    "source_dump_statements": "SELECT 'INSERT INTO ' AS kind, count(*) AS statements FROM documents",
    "source_workbook": "SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM part",
    "sink_results": _describe_sql("lineitem", ["l_quantity", "l_extendedprice"], 4),
    "sink_detail_table": """WITH s AS (SELECT c_mktsegment AS label, sum(c_acctbal) AS value FROM customer GROUP BY 1),
 r AS (SELECT *, sum(value) OVER (ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING) AS run, sum(value) OVER () AS total FROM s)
 SELECT label, round(value, 2) AS value, round(value/total*100, 4) AS pct, round(run/total*100, 4) AS cumulative_pct, (run - value)/total*100 < 80 AS in_80
 FROM r ORDER BY r.value DESC LIMIT 10""",
    "validate_all": _validate_sql(
        "orders",
        """SELECT count(*) AS n, 1 AS dates, 3 AS nums, 2 AS cats, count(DISTINCT o_orderstatus) AS levels,
 count(DISTINCT o_orderkey) = 2 OR count(DISTINCT o_custkey) = 2 OR count(DISTINCT o_totalprice) = 2 OR count(DISTINCT o_orderstatus) = 2
  OR count(DISTINCT o_orderdate) = 2 OR count(DISTINCT o_orderpriority) = 2 AS two,
 false AS durations, count(DISTINCT o_custkey) BETWEEN 2 AND 0.9*count(*) AS users,
 count(DISTINCT o_orderstatus) >= 3 OR count(DISTINCT o_orderpriority) >= 3 AS three FROM orders""",
    ),
    "validate_all_labels": _validate_sql(
        "labels",
        """SELECT count(*) AS n, 0 AS dates, 3 AS nums, 0 AS cats, 0 AS levels, count(DISTINCT quality) = 2 OR count(DISTINCT toxic) = 2 AS two,
 min(doc_id) >= 0 AND count(DISTINCT doc_id) > 2 AND (bool_and(quality IN (0, 1)) OR bool_and(toxic IN (0, 1))) AS durations, false AS users, false AS three FROM labels""",
    ),
    "guardrail_logistic": """WITH c AS (SELECT count(*) FILTER (n_chars > 10000) AS a, count(*) FILTER (n_chars <= 10000) AS b FROM labels JOIN documents USING (doc_id)),
 r AS (SELECT greatest(a, b) AS hi, least(a, b) AS lo FROM c)
 SELECT 'class_balance' AS test, 'rare' AS "column", round(hi/lo::DOUBLE, 1) AS stat, NULL::DOUBLE AS p_value, false AS passed FROM r WHERE lo > 0 AND hi/lo::DOUBLE > 10
 UNION ALL SELECT 'sample_size', 'rare', lo::DOUBLE, NULL, false FROM r WHERE lo > 0 AND lo < 50""",
    "guardrail_kmeans": """WITH s AS (SELECT stddev_samp(l_quantity) AS a, stddev_samp(l_extendedprice) AS b, stddev_samp(l_tax) AS c FROM lineitem)
 SELECT 'feature_scaling' AS test, 'l_extendedprice' AS "column", round(greatest(a, b, c)/least(a, b, c), 1) AS stat, NULL::DOUBLE AS p_value, false AS passed
 FROM s WHERE greatest(a, b, c)/least(a, b, c) > 10""",
    "guardrail_series": """WITH g AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts)/86400000000.0::DOUBLE AS gap FROM events),
 m AS (SELECT median(gap) AS m, max(gap) AS x FROM g)
 SELECT 'temporal_gaps' AS test, 'ts' AS "column", floor(x) AS stat, NULL::DOUBLE AS p_value, false AS passed FROM m WHERE x > 10*m""",
    "guardrail_summary": """SELECT 'clustering_kmeans' AS analysis_id, NOT (stddev_samp(l_extendedprice)/stddev_samp(l_quantity) > 10) AS passed,
 CASE WHEN stddev_samp(l_extendedprice)/stddev_samp(l_quantity) > 10 THEN 1 ELSE 0 END AS failed FROM lineitem""",
    "quality_sheet": """WITH g AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) AS gap FROM events),
 w AS (SELECT 'time_series_arima' AS analysis_id FROM g HAVING max(gap) > 10*median(gap)
  UNION ALL SELECT 'clustering_kmeans' FROM lineitem HAVING stddev_samp(l_extendedprice) > 10*stddev_samp(l_quantity))
 SELECT analysis_id, 'warning' AS status FROM w UNION ALL SELECT '(overall)', CASE WHEN count(*) = 0 THEN 'good' ELSE count(*) || ' warnings' END FROM w""",
    "confidence_scores": """WITH f AS (SELECT p_brand, count(*) AS rows, avg((p_size > 25)::INT) AS ms, min(p_size) + 1 AS failed, max(p_retailprice)/2000 AS r2, min(p_retailprice)/3100 AS sil FROM part GROUP BY 1)
 SELECT p_brand, round(greatest(0, least(1, 1 - (CASE WHEN rows < 30 THEN 0.4 WHEN rows < 100 THEN 0.2 WHEN rows < 500 THEN 0.1 ELSE 0 END
  + CASE WHEN ms > 0.5 THEN 0.3 WHEN ms > 0.2 THEN 0.15 ELSE 0 END + least(0.1*failed, 0.35) + CASE WHEN r2 < 0.3 THEN 0.2 WHEN r2 > 0.7 THEN -0.05 ELSE 0 END
  + CASE WHEN sil < 0.3 THEN 0.15 ELSE 0 END)))::DOUBLE, 2) AS score,
  (rows < 100)::INT + (ms > 0.2)::INT + (failed > 0)::INT + (r2 < 0.3)::INT + (sil < 0.3)::INT AS reasons FROM f""",
    "key_findings": """SELECT o_orderpriority AS analysis_name, 'status: ' || o_orderstatus || '; customer: ' || o_custkey || '; key: ' || o_orderkey AS finding FROM orders ORDER BY o_orderkey DESC LIMIT 5""",
    "results_log": """SELECT 'descriptive_stats' AS analysis_id, true AS success, count(*) AS rows FROM customer UNION ALL SELECT 'descriptive_stats', true, count(*) FROM nation""",
    "batch_scores": """SELECT unnest(['descriptive_stats', 'anova', 'pareto']) AS analysis_id, count(*) AS rows, 0.0::DOUBLE AS missing_share FROM customer""",
    "dbscan_eps": f"{KD_SQL} SELECT round(quantile_cont(kd, 0.9), 6) AS eps FROM kd",
    "dbscan_neighbor_distances": f"{KD_SQL} SELECT round(quantile_cont(kd, 0.1), 6) AS p10, round(quantile_cont(kd, 0.5), 6) AS p50, round(max(kd), 6) AS p100 FROM kd",
    "dbscan_metrics": f"""WITH RECURSIVE {PART_Z}, e AS (SELECT a.id AS a, b.id AS b FROM z a, z b WHERE power(a.x-b.x, 2) + power(a.y-b.y, 2) <= 0.15*0.15),
 core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 5),
 ce AS (SELECT a, b FROM e WHERE a IN (FROM core) AND b IN (FROM core)),
 walk AS (SELECT id AS node, id AS seed FROM core UNION SELECT ce.b, walk.seed FROM walk JOIN ce ON ce.a = walk.node WHERE walk.seed <= ce.b),
 lab AS (SELECT node, min(seed) AS c FROM walk GROUP BY node)
 SELECT (SELECT count(DISTINCT c) FROM lab) AS n_clusters,
 (SELECT count(*) FROM z WHERE id NOT IN (SELECT a FROM e WHERE b IN (FROM core))) AS n_noise, (SELECT count(*) FROM core) AS n_core, 0.15::DOUBLE AS eps""",
}
