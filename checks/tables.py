"""Registered queries: filters, projections, merges, SQL, profile, cleaning, descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.support import DIRTY_SQL, dirty_customer, rounded, table
from statloom.operators import clean, counts, describe, profile, relational


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pareto of revenue by brand."""
    from statloom.operators.business import pareto

    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    revenue = rows.select("p_brand", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return rounded(pareto(revenue, "p_brand", "revenue"), 6, value=2)


def filter_regex(spark, sf):
    return relational.filter_contains(table(spark, sf, "part"), "p_type", "^(promo|large)").select(
        "p_partkey", "p_type"
    )


def filter_number_text(spark, sf):
    return relational.filter_contains(table(spark, sf, "orders"), "o_custkey", "9$").select("o_orderkey")


def role_projection(spark, sf):
    df = relational.project_role(table(spark, sf, "customer"), "numeric")
    return rounded(df)


def template_columns(spark, sf):
    return relational.select_columns(table(spark, sf, "orders"), ["o_orderstatus", "o_orderkey", "absent"])


def _text_dates(spark, sf):
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "O", F.date_format(day, "MM/dd/yyyy"))
        .otherwise(F.date_format(day, "d MMM yyyy"))
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("day_text"), "o_orderpriority")


def date_like(spark, sf):
    return relational.date_like_strings(_text_dates(spark, sf))


def mixed_dates(spark, sf):
    df = _text_dates(spark, sf)
    return df.groupBy(relational.as_timestamp(df, "day_text").cast("date").alias("day")).agg(
        F.count("*").alias("orders")
    )


def listwise_deletion(spark, sf):
    return (
        relational.drop_missing(dirty_customer(spark, sf), ["c_acctbal", "c_mktsegment"])
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("rows"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    )


def _parties(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_nationkey AS nation", "c_acctbal AS balance", "c_mktsegment AS segment")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_nationkey AS nation", "s_acctbal AS balance", "s_name AS supplier")
    return {"customer": c, "supplier": s}


PARTIES_SQL = """parties AS (
 SELECT 'customer' AS __source__, c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS supplier FROM customer
 UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, s_acctbal, NULL, s_name FROM supplier)"""


def merged_tables(spark, sf):
    return rounded(relational.merge_tables(_parties(spark, sf)))


def grouping_targets(spark, sf):
    merged = relational.merge_tables(_parties(spark, sf))
    out = relational.aggregate_targets(
        merged, [F.count("*").alias("rows"), F.avg("balance").alias("mean_balance"), F.stddev_samp("balance").alias("std_balance")]
    )
    return rounded(out)


def separate_targets(spark, sf):
    parts = [
        df.agg(F.count("*").alias("rows"), F.avg("balance").alias("mean_balance")).select(F.lit(n).alias("target"), "*")
        for n, df in relational.analysis_targets(_parties(spark, sf), "auto").items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


def source_comparison(spark, sf):
    return rounded(relational.compare_sources(relational.merge_tables(_parties(spark, sf)), ["balance"]), 6, balance_sum=2)


JOIN_SQL = """
SELECT r_name AS region, n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name"""
LEFT_SQL = """
SELECT c_mktsegment AS segment, count(*) AS rows, count(o_orderkey) AS orders
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_mktsegment"""
SEMI_SQL = """
SELECT c_mktsegment AS segment, count(*) AS customers FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY c_mktsegment"""
ANTI_SQL = """
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')"""


def _sql(text: str, *names: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return relational.run_query(spark, {n: table(spark, sf, n) for n in names}, text)

    return run


def query_as_source(spark, sf):
    text = """SELECT c_mktsegment, o_totalprice, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey"""
    result = _sql(text, "orders", "customer")(spark, sf)
    return rounded(describe.group_boxes(result, "o_totalprice", "c_mktsegment"), 4)


def random_rows(spark, sf):
    return relational.random_rows(table(spark, sf, "customer"), "c_custkey")


def head_rows(spark, sf):
    return rounded(relational.head_rows(table(spark, sf, "supplier"), ["s_suppkey"]))


def catalog(spark, sf):
    from statloom.sources.files import catalog_summary

    return catalog_summary({n: table(spark, sf, n) for n in ("region", "lineitem", "orders")})


def profile_columns(spark, sf):
    return rounded(profile.profile_columns(dirty_customer(spark, sf)).drop("dtype"), 4)


def profile_top(spark, sf):
    return profile.profile_top_values(dirty_customer(spark, sf))


def profile_dates(spark, sf):
    df = profile.profile_ranges(table(spark, sf, "lineitem"))
    return df.select("column", F.to_date("min").alias("first_day"), F.to_date("max").alias("last_day"))


def duplicates(spark, sf):
    return counts.duplicate_count(dirty_customer(spark, sf))


def profile_totals(spark, sf):
    return rounded(profile.profile_summary(dirty_customer(spark, sf)), 1)


def issues(spark, sf):
    return clean.detect_issues(dirty_customer(spark, sf))


def outliers_by_quartiles(spark, sf):
    df = table(spark, sf, "events").select("value")
    return clean.outlier_issues(df).select("column", "count", "severity")


def deduplicated(spark, sf):
    return rounded(clean.drop_duplicate_rows(dirty_customer(spark, sf)))


def filled(spark, sf):
    return rounded(clean.fill_missing(dirty_customer(spark, sf), ["c_acctbal", "c_mktsegment"]), 4)


def cleaned(spark, sf):
    return rounded(clean.apply_all_fixes(dirty_customer(spark, sf))[0], 4)


def cleaning_log(spark, sf):
    return clean.apply_all_fixes(dirty_customer(spark, sf))[1]


def overview(spark, sf):
    return describe.overview(dirty_customer(spark, sf))


def describe_numbers(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(describe.describe(table(spark, sf, "lineitem"), columns), 4)


def frequencies(spark, sf):
    return describe.frequencies(table(spark, sf, "part").select("p_brand", "p_type"))


def boxes(spark, sf):
    return rounded(describe.group_boxes(table(spark, sf, "events"), "value", "event_type"), 6)


def category_counts(spark, sf):
    return describe.category_counts(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


def shapes(spark, sf):
    return rounded(describe.shape_statistics(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), 6)


def histogram(spark, sf):
    return rounded(describe.histogram(table(spark, sf, "orders"), "o_totalprice"), 4)


def top_frequencies(spark, sf):
    return describe.top_frequencies(table(spark, sf, "part"), "p_brand")


QUERIES = {
    "pareto_revenue_by_brand": flagship,
    "filter_contains_regex": filter_regex,
    "filter_contains_number": filter_number_text,
    "project_numeric_role": role_projection,
    "select_template_columns": template_columns,
    "date_like_strings": date_like,
    "parse_mixed_dates": mixed_dates,
    "drop_missing_rows": listwise_deletion,
    "merge_with_source": merged_tables,
    "targets_grouping_sets": grouping_targets,
    "targets_auto": separate_targets,
    "compare_sources": source_comparison,
    "sql_inner_joins": _sql(JOIN_SQL, "orders", "customer", "nation", "region"),
    "sql_left_join": _sql(LEFT_SQL, "customer", "orders"),
    "sql_semi_join": _sql(SEMI_SQL, "customer", "orders"),
    "sql_anti_join": _sql(ANTI_SQL, "customer", "orders"),
    "query_result_as_source": query_as_source,
    "random_row_sample": random_rows,
    "head_sample": head_rows,
    "catalog_summary": catalog,
    "profile_columns": profile_columns,
    "profile_top_values": profile_top,
    "profile_date_ranges": profile_dates,
    "duplicate_rows": duplicates,
    "profile_summary": profile_totals,
    "detect_issues": issues,
    "outliers_iqr": outliers_by_quartiles,
    "drop_duplicate_rows": deduplicated,
    "fill_missing": filled,
    "apply_all_fixes": cleaned,
    "cleaning_log": cleaning_log,
    "descriptive_overview": overview,
    "describe_numeric": describe_numbers,
    "categorical_frequencies": frequencies,
    "box_plot_by_group": boxes,
    "category_by_category": category_counts,
    "shape_statistics": shapes,
    "histogram_30_bins": histogram,
    "top_15_frequencies": top_frequencies,
}


def _box_sql(value: str, group: str, source: str, digits: int) -> str:
    return f"""
WITH v AS (SELECT {group} AS grp, {value} AS v FROM {source}),
q AS (SELECT grp, quantile_cont(v, 0.0) AS minimum, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.75) AS q3, quantile_cont(v, 1.0) AS maximum, count(*) AS count FROM v GROUP BY grp)
SELECT grp AS "group", round(minimum, {digits}) AS minimum, round(q1, {digits}) AS q1, round(median, {digits}) AS median,
 round(q3, {digits}) AS q3, round(maximum, {digits}) AS maximum, count,
 (SELECT round(min(v), {digits}) FROM v WHERE v.grp = q.grp AND v >= q1 - 1.5*(q3-q1)) AS whisker_low,
 (SELECT round(max(v), {digits}) FROM v WHERE v.grp = q.grp AND v <= q3 + 1.5*(q3-q1)) AS whisker_high FROM q"""


def _describe_sql(source: str, columns: list[str], digits: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), {digits}) AS mean, round(stddev_samp({c}), {digits}) AS std,
 round(min({c}), {digits}) AS min, round(max({c}), {digits}) AS max, round(quantile_cont({c}, 0.25), {digits}) AS p25,
 round(quantile_cont({c}, 0.5), {digits}) AS p50, round(quantile_cont({c}, 0.75), {digits}) AS p75 FROM {source}"""
        for c in columns
    )


def _issue(column: str, fix: str) -> str:
    return f"""SELECT '{column}' AS "column", 'missing_values' AS issue_type,
 CASE WHEN m > 0.3*n THEN 'high' WHEN m > 0.1*n THEN 'medium' ELSE 'low' END AS severity, m AS count, true AS auto_fixable,
 'Fill ' || m || ' missing values with {fix}' AS fix_description
 FROM (SELECT count(*) - count({column}) AS m, count(*) AS n FROM dirty) WHERE m > 0"""


def _outlier(column: str) -> str:
    return f"""SELECT '{column}' AS "column", 'outliers' AS issue_type, 'low' AS severity, c AS count, false AS auto_fixable,
 c || ' outliers detected (IQR method)' AS fix_description FROM (
 SELECT count(*) AS c FROM dirty, (SELECT quantile_cont({column}, 0.25) AS a, quantile_cont({column}, 0.75) AS b FROM dirty)
 WHERE {column} < a - 1.5*(b-a) OR {column} > b + 1.5*(b-a)) WHERE c > 0"""


ISSUES_SQL = f"""WITH {DIRTY_SQL},
dup AS (SELECT (SELECT count(*) FROM dirty) AS n, (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS d)
SELECT '(all)' AS "column", 'duplicates' AS issue_type, CASE WHEN d < 0.1*n THEN 'medium' ELSE 'high' END AS severity, d AS count,
 true AS auto_fixable, 'Remove ' || d || ' duplicate rows' AS fix_description FROM dup WHERE d > 0
UNION ALL {_issue("c_acctbal", "median")} UNION ALL {_issue("c_mktsegment", "mode")}
UNION ALL {_outlier("c_custkey")} UNION ALL {_outlier("c_nationkey")} UNION ALL {_outlier("c_acctbal")}"""

MODE_SQL = "(SELECT c_mktsegment FROM {t} WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
FILL_SQL = """SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM {t})), 4) AS c_acctbal,
 coalesce(c_mktsegment, """ + MODE_SQL + """) AS c_mktsegment FROM {t}"""


def _profile_sql() -> str:
    numeric = ["c_custkey", "c_nationkey", "c_acctbal"]
    parts = [
        f"""SELECT '{c}' AS "column", 'numeric' AS type, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique",
 round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 1) AS missing_pct, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(median({c}), 4) AS median FROM dirty"""
        for c in numeric
    ]
    parts.append(
        """SELECT 'c_mktsegment', 'categorical', count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment),
 round((count(*) - count(c_mktsegment)) * 100.0::DOUBLE / count(*), 1), NULL, NULL, NULL, NULL, NULL FROM dirty"""
    )
    return f"WITH {DIRTY_SQL} " + " UNION ALL ".join(parts)


SUMMARY_CTE = f"""WITH {DIRTY_SQL}, t AS (SELECT count(*) AS n, 4*count(*) - count(c_custkey) - count(c_nationkey) - count(c_acctbal) - count(c_mktsegment) AS m FROM dirty),
u AS (SELECT (SELECT n FROM t) - count(*) AS d FROM (SELECT DISTINCT * FROM dirty))"""

ORACLES = {
    "random_row_sample": "SELECT * FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 20",
    "catalog_summary": """SELECT 'region' AS "table", (SELECT count(*) FROM region) AS "rows", c AS "column", t AS type, o AS ordinal, 0 AS more
 FROM (VALUES ('r_regionkey', 'int', 1), ('r_name', 'string', 2)) v(c, t, o)
 UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), c, t, o, 0 FROM (VALUES ('o_orderkey', 'bigint', 1), ('o_custkey', 'bigint', 2),
 ('o_orderstatus', 'string', 3), ('o_totalprice', 'double', 4), ('o_orderdate', 'timestamp_ntz', 5), ('o_orderpriority', 'string', 6)) v(c, t, o)
 UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), c, t, o, 3 FROM (VALUES ('l_orderkey', 'bigint', 1), ('l_partkey', 'bigint', 2),
 ('l_suppkey', 'bigint', 3), ('l_linenumber', 'int', 4), ('l_quantity', 'double', 5), ('l_extendedprice', 'double', 6), ('l_discount', 'double', 7),
 ('l_tax', 'double', 8)) v(c, t, o)""",
    "pareto_revenue_by_brand": """
WITH s AS (SELECT p_brand AS label, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
r AS (SELECT *, sum(value) OVER (ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING) AS run, sum(value) OVER () AS total FROM s)
SELECT label, round(value, 2) AS value, round(value/total*100, 6) AS pct, round(run/total*100, 6) AS cumulative_pct, (run - value)/total*100 < 80 AS in_80 FROM r""",
    "filter_contains_regex": "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(promo|large)', 'i')",
    "filter_contains_number": "SELECT o_orderkey FROM orders WHERE CAST(o_custkey AS VARCHAR) LIKE '%9'",
    "project_numeric_role": "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM customer",
    "select_template_columns": "SELECT o_orderstatus, o_orderkey FROM orders",
    "date_like_strings": "SELECT 'day_text' AS \"column\", true AS date_like UNION ALL SELECT 'o_orderpriority', bool_and(try_cast(o_orderpriority AS DATE) IS NOT NULL) FROM orders",
    "parse_mixed_dates": "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1",
    "drop_missing_rows": f"WITH {DIRTY_SQL} SELECT c_mktsegment, count(*) AS rows, round(sum(c_acctbal), 2) AS balance FROM dirty WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1",
    "merge_with_source": f"WITH {PARTIES_SQL} SELECT __source__, key, CAST(nation AS BIGINT) AS nation, round(balance, 6) AS balance, segment, supplier FROM parties",
    "targets_grouping_sets": f"""WITH {PARTIES_SQL} SELECT coalesce(__source__, '__merged__') AS target, count(*) AS rows, round(avg(balance), 6) AS mean_balance,
 round(stddev_samp(balance), 6) AS std_balance FROM parties GROUP BY GROUPING SETS ((__source__), ())""",
    "targets_auto": f"""WITH {PARTIES_SQL} SELECT coalesce(__source__, '__merged__') AS target, count(*) AS rows, round(avg(balance), 6) AS mean_balance
 FROM parties GROUP BY ROLLUP (__source__)""",
    "compare_sources": f"WITH {PARTIES_SQL} SELECT __source__, count(*) AS rows, round(sum(balance), 2) AS balance_sum, round(avg(balance), 6) AS balance_mean FROM parties GROUP BY 1",
    "sql_inner_joins": JOIN_SQL,
    "sql_left_join": LEFT_SQL,
    "sql_semi_join": SEMI_SQL,
    "sql_anti_join": ANTI_SQL,
    "query_result_as_source": _box_sql("o_totalprice", "c_mktsegment", "orders JOIN customer ON o_custkey = c_custkey", 4),
    "head_sample": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(s_acctbal, 6) AS s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 5",
    "profile_columns": _profile_sql(),
    "profile_top_values": f"""WITH {DIRTY_SQL} SELECT * FROM (SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) AS n,
 row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS rank FROM dirty WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment) WHERE rank <= 5""",
    "profile_date_ranges": "SELECT 'l_shipdate' AS \"column\", CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem",
    "duplicate_rows": f"WITH {DIRTY_SQL} SELECT (SELECT count(*) FROM dirty) AS rows, (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates",
    "profile_summary": f"""{SUMMARY_CTE} SELECT n AS row_count, 4 AS col_count,
 round((1 - m/(4.0::DOUBLE*n))*100*0.7::DOUBLE + (1 - d/n::DOUBLE)*100*0.3::DOUBLE, 1) AS quality_score, m AS total_missing,
 round(m*100.0::DOUBLE/(4*n), 1) AS total_missing_pct, d AS duplicate_rows, 3 AS numeric_columns, 1 AS categorical_columns FROM t, u""",
    "detect_issues": ISSUES_SQL,
    "outliers_iqr": """WITH e AS (SELECT value FROM events),
 q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM e)
 SELECT 'value' AS "column", count(*) AS count, 'low' AS severity FROM e, q WHERE value < a - 1.5*(b-a) OR value > b + 1.5*(b-a) HAVING count(*) > 0""",
    "drop_duplicate_rows": f"WITH {DIRTY_SQL} SELECT DISTINCT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM dirty",
    "fill_missing": f"WITH {DIRTY_SQL} " + FILL_SQL.format(t="dirty"),
    "apply_all_fixes": f"WITH {DIRTY_SQL}, uniq AS (SELECT DISTINCT * FROM dirty) " + FILL_SQL.format(t="uniq"),
    "cleaning_log": f"SELECT \"column\", issue_type, count, CASE WHEN auto_fixable THEN 'applied' ELSE 'skipped' END AS outcome FROM ({ISSUES_SQL})",
    "descriptive_overview": f"""{SUMMARY_CTE} SELECT unnest(['rows', 'columns', 'numeric_columns', 'categorical_columns', 'missing_values', 'duplicate_rows']) AS metric,
 unnest([n, 4, 3, 1, m, d]) AS value FROM t, u""",
    "describe_numeric": _describe_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 4),
    "categorical_frequencies": " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", value, n, rank, (SELECT count(DISTINCT {c}) FROM part) AS unique_count, (SELECT count({c}) FROM part) AS total_non_null
 FROM (SELECT {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM part GROUP BY {c}) WHERE rank <= 10)"""
        for c in ("p_brand", "p_type")
    ),
    "box_plot_by_group": _box_sql("value", "event_type", "events", 6),
    "category_by_category": 'SELECT o_orderstatus AS "group", o_orderpriority AS target, count(*) AS count FROM orders GROUP BY 1, 2',
    "shape_statistics": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(var_samp({c}), 6) AS variance,
 round(avg(power({c} - m, 3)) / power(var_pop({c}), 1.5), 6) AS skewness, round(kurtosis_pop({c}), 6) AS kurtosis,
 round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr,
 round((SELECT {c} FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), 6) AS mode
 FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)"""
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
    "histogram_30_bins": """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice))/30 AS w FROM orders)
 SELECT bin, round(lo + bin*w, 4) AS low, round(lo + bin*w + w, 4) AS high, count(*) AS count
 FROM (SELECT least(CAST(floor((o_totalprice - lo)/w) AS BIGINT), 29) AS bin, lo, w FROM orders, e) GROUP BY bin, lo, w""",
    "top_15_frequencies": "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
}
