"""Registered queries: correlation, hypothesis tests, survival, business, anomalies, baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.support import SURVIVAL_SQL, chi2_tail, f_tail, reorder_times, rounded, table
from statloom.operators import anomaly, basket, business, correlation, hypothesis, survival

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pearson(spark, sf):
    return rounded(correlation.pearson_pairs(table(spark, sf, "lineitem"), MEASURES))


def pearson_constant(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", F.lit(3.0).alias("same"), "l_tax")
    return rounded(correlation.pearson_pairs(rows, ["l_quantity", "same", "l_tax"]))


def spearman(spark, sf):
    return rounded(correlation.spearman_pairs(table(spark, sf, "lineitem"), MEASURES))


def spearman_missing(spark, sf):
    """Pairwise deletion: the two columns are missing on different rows."""
    df = table(spark, sf, "customer").select(
        F.expr("CASE WHEN c_acctbal >= 0 THEN c_acctbal END").alias("balance"),
        F.expr("CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey END").alias("nation"),
        F.length("c_name").alias("name_length"),
        F.col("c_custkey").alias("customer"),
    )
    return rounded(correlation.spearman_pairs(df, ["balance", "nation", "customer"]))


def top_pairs(spark, sf):
    pairs = correlation.correlation_pairs(table(spark, sf, "lineitem"), MEASURES)
    return rounded(correlation.top_pairs(pairs))


def heat_map(spark, sf):
    pairs = correlation.pearson_pairs(table(spark, sf, "lineitem"), MEASURES)
    return rounded(correlation.heat_map(pairs, MEASURES))


def ttest(spark, sf):
    out = hypothesis.ttest(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus")
    return rounded(out.drop("ci_low", "ci_high"), 6, mean1=4, mean2=4, difference=4, std_error=4)


def difference_interval(spark, sf):
    out = hypothesis.ttest(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus")
    return rounded(out.select("group1", "group2", "difference", "ci_low", "ci_high"), 3)


def anova(spark, sf):
    out = hypothesis.anova(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment")
    return rounded(out, 6, ss_between=1, ss_within=1)


def pairwise(spark, sf):
    return rounded(hypothesis.pairwise_comparison(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment"), 5)


def tukey(spark, sf):
    return rounded(hypothesis.tukey_hsd(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment"), 5)


def chi_square(spark, sf):
    return rounded(hypothesis.chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


def chi_square_yates(spark, sf):
    df = table(spark, sf, "labels").select(
        F.col("quality").cast("string").alias("q"), F.col("toxic").cast("string").alias("t")
    )
    return rounded(hypothesis.chi_square(df, "q", "t"))


def contingency(spark, sf):
    return hypothesis.contingency_grid(table(spark, sf, "documents"), "source", "lang")


def mann_whitney(spark, sf):
    return rounded(hypothesis.mann_whitney(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus"), 6, median1=4, median2=4)


def mann_whitney_ties(spark, sf):
    return rounded(hypothesis.mann_whitney(table(spark, sf, "lineitem"), "l_quantity", "l_linestatus"))


def levene(spark, sf):
    return rounded(hypothesis.levene(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment"))


def kaplan_meier(spark, sf):
    return rounded(survival.kaplan_meier(reorder_times(spark, sf), "duration", "event"))


def survival_summary(spark, sf):
    return rounded(survival.survival_summary(survival.kaplan_meier(reorder_times(spark, sf), "duration", "event")))


def survival_columns(spark, sf):
    duration, event = survival.survival_columns(reorder_times(spark, sf), {})
    return rounded(survival.survival_summary(survival.kaplan_meier(reorder_times(spark, sf), duration, event)))


def log_rank(spark, sf):
    df = reorder_times(spark, sf).withColumn("grp", F.when(F.col("segment") == "BUILDING", "a").otherwise("b"))
    return rounded(survival.log_rank(df, "duration", "event", "grp"), 5)


def log_rank_segments(spark, sf):
    ranked = survival.log_rank(reorder_times(spark, sf), "duration", "event", "segment")
    return rounded(ranked.select("group", "observed", "expected"), 5)


def pareto_nation(spark, sf):
    df = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("n_name", "o_totalprice")


def pareto_summary(spark, sf):
    return rounded(business.pareto_summary(business.pareto(pareto_nation(spark, sf), "n_name", "o_totalprice")), 2)


def pareto_top(spark, sf):
    return rounded(business.pareto_top(business.pareto(pareto_nation(spark, sf), "n_name", "o_totalprice")), 6, value=2)


def pareto_customers(spark, sf):
    """Many categories: every customer is one."""
    df = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("customer"), "o_totalprice")
    return rounded(business.pareto(df, "customer", "o_totalprice"), 5, value=2)


def cohort(spark, sf):
    return rounded(business.cohort(table(spark, sf, "orders"), "o_custkey", "o_orderdate"))


def cohort_auto(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    user, date = business.cohort_columns(df, {})
    return rounded(business.cohort(df, user, date).groupBy("period").agg(F.sum("users").alias("users")))


def z_summary(spark, sf):
    df = table(spark, sf, "events").select("value", F.col("user_id").cast("double").alias("user_id"))
    return rounded(anomaly.z_score_summary(df, ["value", "user_id"]))


def z_top(spark, sf):
    return rounded(anomaly.z_score_top(table(spark, sf, "events"), ["value"], "event_id"))


def z_top_orders(spark, sf):
    return rounded(anomaly.z_score_top(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], "o_orderkey"))


def z_histogram(spark, sf):
    scores = anomaly.z_scores(table(spark, sf, "events"), ["value"])
    return rounded(anomaly.score_histogram(scores, "max_z"), 5)


def isolation_summary(spark, sf):
    scores = anomaly.isolation_scores(table(spark, sf, "lineitem"), MEASURES, ["l_orderkey", "l_linenumber"])
    return rounded(anomaly.isolation_summary(scores))


def isolation_top(spark, sf):
    scores = anomaly.isolation_scores(table(spark, sf, "events"), ["value", "user_id"], ["event_id"])
    return rounded(anomaly.isolation_top(scores, "event_id"))


def isolation_histogram(spark, sf):
    scores = anomaly.isolation_scores(table(spark, sf, "events"), ["value", "user_id"], ["event_id"])
    return rounded(anomaly.score_histogram(scores, "score"))


def _lines(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias("order_id"), F.col("p_brand").alias("product"))
    )


def itemsets(spark, sf):
    sets = basket.frequent_itemsets(_lines(spark, sf), *basket.basket_columns(_lines(spark, sf), {}))
    return rounded(sets.select(F.concat_ws(",", "items").alias("items"), "length", "freq", "support", "transactions"))


def rules(spark, sf):
    sets = basket.frequent_itemsets(_lines(spark, sf), "order_id", "product")
    out = basket.association_rules(sets, 0.1, 0.0)
    return rounded(
        out.select(F.concat_ws(",", "antecedent").alias("antecedent"), F.concat_ws(",", "consequent").alias("consequent"), "support", "confidence", "lift")
    )


def _document_words(spark, sf):
    """Each user's event days as baskets: a basket is a user and day, an item the event type."""
    return table(spark, sf, "events").select(
        F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("basket_id"), F.col("event_type").alias("item")
    )


def event_rules(spark, sf):
    sets = basket.frequent_itemsets(_document_words(spark, sf), "basket_id", "item")
    out = basket.association_rules(sets)
    return rounded(
        out.select(F.concat_ws(",", "antecedent").alias("antecedent"), F.concat_ws(",", "consequent").alias("consequent"), "support", "confidence", "lift")
    )


def top_rules(spark, sf):
    sets = basket.frequent_itemsets(_document_words(spark, sf), "basket_id", "item")
    out = basket.top_rules(basket.association_rules(sets))
    return rounded(out.select(F.concat_ws(",", "antecedent").alias("antecedent"), F.concat_ws(",", "consequent").alias("consequent"), "lift"))


def basket_shape(spark, sf):
    df = _lines(spark, sf)
    return basket.basket_shape(df, *basket.basket_columns(df, {}))


QUERIES = {
    "correlation_pearson": pearson,
    "correlation_constant_column": pearson_constant,
    "correlation_spearman": spearman,
    "correlation_spearman_missing": spearman_missing,
    "correlation_top_pairs": top_pairs,
    "correlation_heat_map": heat_map,
    "ttest": ttest,
    "ttest_interval": difference_interval,
    "anova": anova,
    "anova_pairwise": pairwise,
    "anova_tukey": tukey,
    "chi_square": chi_square,
    "chi_square_yates": chi_square_yates,
    "contingency_heat_map": contingency,
    "mann_whitney": mann_whitney,
    "mann_whitney_ties": mann_whitney_ties,
    "levene": levene,
    "kaplan_meier": kaplan_meier,
    "survival_summary": survival_summary,
    "survival_auto_columns": survival_columns,
    "log_rank": log_rank,
    "log_rank_segments": log_rank_segments,
    "pareto_summary": pareto_summary,
    "pareto_top_10": pareto_top,
    "pareto_many_categories": pareto_customers,
    "cohort_retention": cohort,
    "cohort_auto_columns": cohort_auto,
    "zscore_summary": z_summary,
    "zscore_top": z_top,
    "zscore_top_many_columns": z_top_orders,
    "zscore_histogram": z_histogram,
    "isolation_forest_summary": isolation_summary,
    "isolation_forest_top": isolation_top,
    "isolation_forest_histogram": isolation_histogram,
    "basket_itemsets": itemsets,
    "basket_rules": rules,
    "basket_event_rules": event_rules,
    "basket_top_rules": top_rules,
    "basket_shape": basket_shape,
}


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def _pearson_sql(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 6) AS pearson FROM {source}" for a, b in _pairs(columns)
    )


def _spearman_sql(columns: list[str], source: str) -> str:
    parts = []
    for a, b in _pairs(columns):
        parts.append(
            f"""SELECT '{a}' AS col1, '{b}' AS col2, round(corr(x, y), 6) AS spearman FROM (SELECT
 rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1)/2.0::DOUBLE AS x,
 rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1)/2.0::DOUBLE AS y
 FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        )
    return " UNION ALL ".join(parts)


T_SQL = """
a AS (SELECT count(*) AS n1, avg(o_totalprice) AS m1, var_samp(o_totalprice) AS v1 FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT count(*) AS n2, avg(o_totalprice) AS m2, var_samp(o_totalprice) AS v2 FROM orders WHERE o_orderstatus = 'O'),
s AS (SELECT *, n1+n2-2 AS dof, sqrt(((n1-1)*v1 + (n2-1)*v2)/(n1+n2-2) * (1.0::DOUBLE/n1 + 1.0::DOUBLE/n2)) AS se FROM a, b),
f0 AS (SELECT 1 AS id, power((m1-m2)/se, 2) AS f, 1.0::DOUBLE AS d1, dof::DOUBLE AS d2 FROM s)"""

MOMENTS_SQL = """
g AS (SELECT c_mktsegment AS grp, count(*) AS n, avg(c_acctbal) AS mean, var_samp(c_acctbal) AS var FROM customer GROUP BY 1)"""


def _phi_sql(x: str) -> str:
    """Φ(x) by the same erfc fit as the operator."""
    from statloom.functions.special import ERFC_FIT

    z, t = f"(abs({x}) / sqrt(2.0))", f"(1.0 / (1.0 + 0.5 * abs({x}) / sqrt(2.0)))"
    poly = str(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        poly = f"({poly} * {t} + {c})"
    tail = f"(0.5 * {t} * exp(-{z} * {z} + {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


def _simpson_sql(i: str, last: int) -> str:
    return f"(CASE WHEN {i} = 0 OR {i} = {last} THEN 1.0 WHEN {i} % 2 = 1 THEN 4.0 ELSE 2.0 END)"


TUKEY_SQL = f"""WITH {MOMENTS_SQL},
e AS (SELECT count(*) AS k, sum(n) - count(*) AS dof, sum(CASE WHEN n > 1 THEN (n - 1) * var ELSE 0 END) / (sum(n) - count(*)) AS mse FROM g),
pr AS (SELECT x.grp AS group1, y.grp AS group2, x.mean - y.mean AS difference, abs(x.mean - y.mean) / sqrt(mse / 2 * (1.0 / x.n + 1.0 / y.n)) AS q,
  k::DOUBLE AS k, dof::DOUBLE AS nu FROM g x JOIN g y ON x.grp < y.grp, e),
o AS (SELECT pr.*, j, -8.0 / sqrt(2.0 * nu) - 25.0 / nu AS lo, 8.0 / sqrt(2.0 * nu) AS hi FROM pr, range(0, 241) t(j)),
ox AS (SELECT *, lo + j * ((hi - lo) / 240) AS x, (hi - lo) / 240 AS h FROM o),
inner_terms AS (
  SELECT group1, group2, j, {_simpson_sql('i', 160)} * exp(-(i * 0.1 - 8.0) * (i * 0.1 - 8.0) / 2) / sqrt(2 * pi())
    * power(greatest({_phi_sql('(i * 0.1 - 8.0)')} - {_phi_sql('(i * 0.1 - 8.0 - q * exp(x))')}, 0.0), k - 1) AS v
  FROM ox, range(0, 161) u(i)
), w AS (SELECT group1, group2, j, sum(v) AS s FROM inner_terms GROUP BY ALL),
outer_terms AS (
  SELECT ox.group1, ox.group2, ox.difference, ox.q, ox.nu, {_simpson_sql('ox.j', 240)}
    * exp(nu / 2 * ln(nu) - lgamma(nu / 2) - (nu / 2 - 1) * ln(2.0) + nu * x - nu * exp(x) * exp(x) / 2)
    * least(1.0, k * w.s * (0.1 / 3)) * (h / 3) AS v
  FROM ox JOIN w ON ox.group1 = w.group1 AND ox.group2 = w.group2 AND ox.j = w.j
)
SELECT group1, group2, round(difference, 5) + 0.0 AS difference, round(q, 5) + 0.0 AS q_stat, nu::BIGINT AS dof,
  round(greatest(0.0, least(1.0, 1.0 - sum(v))), 5) + 0.0 AS p_adjusted, 'tukey' AS method, greatest(0.0, least(1.0, 1.0 - sum(v))) < 0.05 AS significant
FROM outer_terms GROUP BY group1, group2, difference, q, nu"""


def _chi_sql(cells: str, yates: bool) -> str:
    gap = "power(greatest(abs(o - e) - 0.5, 0), 2)" if yates else "power(o - e, 2)"
    return f"""WITH cells AS ({cells}),
rr AS (SELECT r, sum(o) AS rn FROM cells GROUP BY r), cc AS (SELECT c, sum(o) AS cn FROM cells GROUP BY c),
tot AS (SELECT sum(o)::DOUBLE AS n, count(DISTINCT r) AS nr, count(DISTINCT c) AS nc FROM cells),
grid AS (SELECT coalesce(o, 0) AS o, rn*cn/n AS e, n, nr, nc FROM rr CROSS JOIN cc CROSS JOIN tot LEFT JOIN cells USING (r, c)),
x0 AS (SELECT 1 AS id, sum({gap}/e) AS x, (max(nr)-1)*(max(nc)-1) AS dof, max(n) AS n, least(max(nr), max(nc)) - 1 AS s FROM grid),
{chi2_tail("x0")}
SELECT round(x, 6) AS chi2, dof, CAST(n AS BIGINT) AS n, round(sqrt(x/(n*s)), 6) AS cramers_v, round(p, 6) AS p_value, p < 0.05 AS significant
FROM x0 JOIN ct USING (id)"""


def _mw_sql(value: str, group: str, source: str, g1: str, g2: str, digits: int) -> str:
    return f"""WITH v AS (SELECT {value} AS v, {group} AS g FROM {source} WHERE {group} IN ('{g1}', '{g2}')),
r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1)/2.0::DOUBLE AS rk FROM v),
t AS (SELECT sum(power(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM v GROUP BY v)),
s AS (SELECT sum(rk) FILTER (g = '{g1}') AS r1, (count(*) FILTER (g = '{g1}'))::DOUBLE AS n1, (count(*) FILTER (g = '{g2}'))::DOUBLE AS n2 FROM r),
u AS (SELECT *, r1 - n1*(n1+1)/2 AS u1, n1+n2 AS n FROM s, t),
z AS (SELECT *, (greatest(u1, n1*n2-u1) - n1*n2/2 - 0.5)/sqrt(n1*n2/12*((n+1) - ties/(n*(n-1)))) AS z FROM u),
x0 AS (SELECT 1 AS id, power(greatest(z, 0), 2) AS x, 1 AS dof FROM z), {chi2_tail("x0")}
SELECT '{g1}' AS group1, '{g2}' AS group2, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
 (SELECT round(median(v), {digits}) FROM v WHERE g = '{g1}') AS median1, (SELECT round(median(v), {digits}) FROM v WHERE g = '{g2}') AS median2,
 round(u1, 6) AS u_stat, round(1 - 2*u1/(n1*n2), 6) AS rank_biserial, round(coalesce(p, 1.0), 6) AS p_value, coalesce(p, 1.0) < 0.05 AS significant
FROM z LEFT JOIN ct ON true"""


KM_SQL = f"""WITH {SURVIVAL_SQL},
t AS (SELECT duration AS time, count(*) AS n, sum(event) AS d FROM surv GROUP BY 1),
r AS (SELECT time, n, d, sum(n) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS risk FROM t),
k AS (SELECT time, risk, d, n - d AS c,
 sum(CASE WHEN d < risk THEN ln(1 - d/risk::DOUBLE) ELSE 0 END) OVER w AS ls,
 sum(CASE WHEN d < risk THEN d/(risk::DOUBLE*(risk-d)) ELSE 0 END) OVER w AS g,
 sum(CASE WHEN d >= risk THEN 1 ELSE 0 END) OVER w AS dead FROM r WINDOW w AS (ORDER BY time ROWS UNBOUNDED PRECEDING)),
km AS (SELECT time, risk, d, c, ls, g, CASE WHEN dead > 0 THEN 0 ELSE exp(ls) END AS s FROM k),
band AS (SELECT *, CASE WHEN s > 0 AND s < 1 THEN power(s, exp(1.959963984540054*sqrt(g)/ls)) ELSE s END AS b1,
 CASE WHEN s > 0 AND s < 1 THEN power(s, exp(-1.959963984540054*sqrt(g)/ls)) ELSE s END AS b2 FROM km)"""

KM_SUMMARY = f"""{KM_SQL} SELECT round(min(time) FILTER (s <= 0.5), 6)::DOUBLE AS median_survival, CAST(sum(d) AS BIGINT) AS events, CAST(sum(d+c) AS BIGINT) AS observations FROM km"""

Z_SQL = "abs({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0)"

NATION_SQL = """s AS (SELECT n_name AS label, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
r AS (SELECT *, sum(value) OVER (ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING) AS run, sum(value) OVER () AS total FROM s)"""

COHORT_SQL = """m AS (SELECT DISTINCT o_custkey AS u, year(o_orderdate)*12 + month(o_orderdate) - 1 AS m FROM orders),
f AS (SELECT u, m, min(m) OVER (PARTITION BY u) AS c FROM m),
cell AS (SELECT c, m - c AS period, count(*) AS users FROM f GROUP BY 1, 2),
size AS (SELECT c, users AS cohort_size FROM cell WHERE period = 0),
grid AS (SELECT size.c, cohort_size, p.period, coalesce(users, 0) AS users FROM size CROSS JOIN (SELECT DISTINCT period FROM cell) p
 LEFT JOIN cell ON cell.c = size.c AND cell.period = p.period)"""


def _basket_sql(lines: str) -> str:
    return f"""WITH l AS ({lines}), n AS (SELECT count(DISTINCT tid)::DOUBLE AS n FROM l),
i1 AS (SELECT item AS a, count(*) AS f FROM l GROUP BY 1),
i2 AS (SELECT x.item AS a, y.item AS b, count(*) AS f FROM l x JOIN l y ON x.tid = y.tid AND x.item < y.item GROUP BY 1, 2),
i3 AS (SELECT x.item AS a, y.item AS b, z.item AS c, count(*) AS f FROM l x JOIN l y ON x.tid = y.tid AND x.item < y.item
 JOIN l z ON x.tid = z.tid AND y.item < z.item GROUP BY 1, 2, 3),
i4 AS (SELECT x.item AS a, y.item AS b, z.item AS c, w.item AS d, count(*) AS f FROM l x JOIN l y ON x.tid = y.tid AND x.item < y.item
 JOIN l z ON x.tid = z.tid AND y.item < z.item JOIN l w ON x.tid = w.tid AND z.item < w.item GROUP BY 1, 2, 3, 4),
i5 AS (SELECT x.item AS a, y.item AS b, z.item AS c, w.item AS d, v.item AS e, count(*) AS f FROM l x JOIN l y ON x.tid = y.tid AND x.item < y.item
 JOIN l z ON x.tid = z.tid AND y.item < z.item JOIN l w ON x.tid = w.tid AND z.item < w.item JOIN l v ON x.tid = v.tid AND w.item < v.item GROUP BY 1, 2, 3, 4, 5),
sets AS (SELECT items, f, f/n AS s, n FROM (SELECT [a] AS items, f FROM i1 UNION ALL SELECT [a, b], f FROM i2 UNION ALL SELECT [a, b, c], f FROM i3
 UNION ALL SELECT [a, b, c, d], f FROM i4 UNION ALL SELECT [a, b, c, d, e], f FROM i5), n WHERE f >= ceil(0.01*n)),
rule AS (SELECT x.items AS ai, y.items AS ci, z.s AS support, z.s/x.s AS confidence, z.s/x.s/y.s AS lift
 FROM sets z JOIN sets x ON list_has_all(z.items, x.items) AND len(x.items) < len(z.items)
 JOIN sets y ON len(y.items) = len(z.items) - len(x.items) AND list_has_all(z.items, y.items) AND NOT list_has_any(x.items, y.items))"""


LINES = "SELECT DISTINCT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
EVENT_LINES = "SELECT DISTINCT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS tid, event_type AS item FROM events"
RULE_COLUMNS = """SELECT array_to_string(ai, ',') AS antecedent, array_to_string(ci, ',') AS consequent, round(support, 6) AS support,
 round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rule"""

ORACLES = {
    "correlation_pearson": _pearson_sql(MEASURES, "lineitem"),
    "correlation_constant_column": """SELECT 'l_quantity' AS col1, 'l_tax' AS col2, round(corr(l_quantity, l_tax), 6) AS pearson FROM lineitem
 UNION ALL SELECT 'l_quantity', 'same', NULL UNION ALL SELECT 'same', 'l_tax', NULL""",
    "log_rank_segments": """WITH """ + SURVIVAL_SQL + """, t AS (SELECT duration, count(*) AS n, sum(event) AS d FROM surv GROUP BY 1),
 r AS (SELECT duration, d, sum(n) OVER (ORDER BY duration DESC) AS at_risk FROM t),
 g AS (SELECT s.segment, r.duration, count(x.segment) AS own FROM (SELECT DISTINCT segment FROM surv) s CROSS JOIN r
   LEFT JOIN surv x ON x.segment = s.segment AND x.duration >= r.duration GROUP BY 1, 2)
 SELECT segment AS "group", observed, expected FROM (SELECT g.segment, round(sum(d * own / at_risk::DOUBLE), 5) AS expected FROM g JOIN r USING (duration) GROUP BY 1)
 JOIN (SELECT segment, sum(event)::DOUBLE AS observed FROM surv GROUP BY 1) USING (segment)""",
    "correlation_spearman": _spearman_sql(MEASURES, "lineitem"),
    "correlation_spearman_missing": """WITH c AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
 CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey END AS nation, c_custkey AS customer FROM customer) """
    + _spearman_sql(["balance", "nation", "customer"], "c"),
    "correlation_top_pairs": f"""SELECT col1, col2, pearson, spearman FROM ({_pearson_sql(MEASURES, "lineitem")}) JOIN ({_spearman_sql(MEASURES, "lineitem")})
 USING (col1, col2) ORDER BY abs(pearson) DESC LIMIT 10""",
    "correlation_heat_map": f"""WITH p AS ({_pearson_sql(MEASURES, "lineitem")}) SELECT col1 AS "row", col2 AS col, pearson FROM p UNION ALL SELECT col2, col1, pearson FROM p
 UNION ALL SELECT unnest({MEASURES!r}) AS m, m, 1.0::DOUBLE""",
    "ttest": f"""WITH {T_SQL}, {f_tail("f0")} SELECT 'F' AS group1, 'O' AS group2, n1, n2, round(m1, 4) AS mean1, round(m2, 4) AS mean2,
 round(m1-m2, 4) AS difference, round(se, 4) AS std_error, dof, round((m1-m2)/se, 6) AS t_stat, round((m1-m2)/sqrt((v1+v2)/2), 6) AS cohens_d,
 round(p, 6) AS p_value, p < 0.05 AS significant FROM s, ft""",
    "ttest_interval": f"""WITH {T_SQL}, q AS (SELECT *, z + (power(z,3)+z)/(4*dof) + (5*power(z,5)+16*power(z,3)+3*z)/(96*power(dof,2)) AS tq
 FROM s, (SELECT 1.959963984540054 AS z))
 SELECT 'F' AS group1, 'O' AS group2, round(m1-m2, 3) AS difference, round(m1-m2-tq*se, 3) AS ci_low, round(m1-m2+tq*se, 3) AS ci_high FROM q""",
    "anova": f"""WITH {MOMENTS_SQL}, w AS (SELECT count(*) AS k, sum(n) AS n, sum(n*power(mean - m, 2)) AS ssb, sum((n-1)*var) AS ssw
 FROM g, (SELECT avg(c_acctbal) AS m FROM customer)),
 f0 AS (SELECT 1 AS id, (ssb/(k-1))/(ssw/(n-k)) AS f, (k-1)::DOUBLE AS d1, (n-k)::DOUBLE AS d2 FROM w), {f_tail("f0")}
 SELECT k AS groups, CAST(n AS BIGINT) AS n, round(ssb, 1) AS ss_between, round(ssw, 1) AS ss_within, round(f, 6) AS f_stat, round(ssb/(ssb+ssw), 6) AS eta_squared,
 round(p, 6) AS p_value, p < 0.05 AS significant FROM w, f0, ft""",
    "anova_tukey": TUKEY_SQL,
    "anova_pairwise": f"""WITH {MOMENTS_SQL}, pr AS (SELECT x.grp AS group1, y.grp AS group2, x.grp || y.grp AS id, x.mean - y.mean AS difference, x.n + y.n - 2 AS dof,
 sqrt(((x.n-1)*x.var + (y.n-1)*y.var)/(x.n+y.n-2)*(1.0::DOUBLE/x.n + 1.0::DOUBLE/y.n)) AS se FROM g x JOIN g y ON x.grp < y.grp),
 f0 AS (SELECT id, power(difference/se, 2) AS f, 1.0::DOUBLE AS d1, dof::DOUBLE AS d2 FROM pr), {f_tail("f0")}
 SELECT group1, group2, round(difference, 5) AS difference, round(difference/se, 5) AS t_stat, dof, round(least(1.0, p*10), 5) AS p_adjusted, 'bonferroni' AS method,
 p*10 < 0.05 AS significant FROM pr JOIN ft USING (id)""",
    "chi_square": _chi_sql("SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS o FROM orders GROUP BY 1, 2", False),
    "chi_square_yates": _chi_sql("SELECT quality AS r, toxic AS c, count(*) AS o FROM labels GROUP BY 1, 2", True),
    "contingency_heat_map": """SELECT r."row", c.col, count(doc_id) AS count FROM (SELECT DISTINCT source AS "row" FROM documents) r CROSS JOIN (SELECT DISTINCT lang AS col FROM documents) c
 LEFT JOIN documents ON source = r."row" AND lang = c.col GROUP BY 1, 2""",
    "mann_whitney": _mw_sql("o_totalprice", "o_orderstatus", "orders", "F", "O", 4),
    "mann_whitney_ties": _mw_sql("l_quantity", "l_linestatus", "lineitem", "F", "O", 6),
    "levene": f"""WITH d AS (SELECT c_mktsegment AS grp, abs(c_acctbal - m) AS v FROM customer JOIN (SELECT c_mktsegment AS s, median(c_acctbal) AS m FROM customer GROUP BY 1) ON c_mktsegment = s),
 g AS (SELECT grp, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM d GROUP BY 1),
 w AS (SELECT count(*) AS k, sum(n) AS n, sum(n*power(mean - m, 2)) AS ssb, sum((n-1)*var) AS ssw FROM g, (SELECT avg(v) AS m FROM d)),
 f0 AS (SELECT 1 AS id, (ssb/(k-1))/(ssw/(n-k)) AS f, (k-1)::DOUBLE AS d1, (n-k)::DOUBLE AS d2 FROM w), {f_tail("f0")}
 SELECT k AS groups, round(f, 6) AS w_stat, round(p, 6) AS p_value FROM w, f0, ft""",
    "kaplan_meier": f"""{KM_SQL} SELECT time::DOUBLE AS time, CAST(risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, CAST(c AS BIGINT) AS censored, round(s, 6) AS survival,
 round(least(b1, b2), 6) AS ci_low, round(greatest(b1, b2), 6) AS ci_high FROM band""",
    "survival_summary": KM_SUMMARY,
    "survival_auto_columns": KM_SUMMARY,
    "log_rank": f"""WITH {SURVIVAL_SQL}, v AS (SELECT *, CASE WHEN segment = 'BUILDING' THEN 'a' ELSE 'b' END AS g FROM surv),
 t AS (SELECT duration AS time, count(*) AS n, sum(event) AS d, count(*) FILTER (g = 'a') AS na, sum(event) FILTER (g = 'a') AS da FROM v GROUP BY 1),
 r AS (SELECT time, d::DOUBLE AS d, coalesce(da, 0) AS da, sum(n) OVER w AS n, sum(na) OVER w AS na FROM t WINDOW w AS (ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT sum(da)::DOUBLE AS oa, sum(d*na/n) AS ea, sum(d) AS dd, sum(CASE WHEN n > 1 THEN d*(n-d)/(n-1)*(na/n)*(1 - na/n) ELSE 0 END) AS va FROM r),
 x0 AS (SELECT 1 AS id, power(oa-ea, 2)/va AS x, 1 AS dof FROM s), {chi2_tail("x0")}
 SELECT g AS "group", round(CASE WHEN g = 'a' THEN oa ELSE dd - oa END, 5) AS observed, round(CASE WHEN g = 'a' THEN ea ELSE dd - ea END, 5) AS expected,
 round(x, 5) AS chi2, 1 AS dof, round(p, 5) AS p_value FROM s, x0, ct, (SELECT unnest(['a', 'b']) AS g)""",
    "pareto_summary": f"""WITH {NATION_SQL} SELECT count(*) AS total_categories, count(*) FILTER ((run - value)/total*100 < 80) AS items_80_pct,
 arg_max(label, value) AS top_category, round(max(value), 2) AS top_value FROM r""",
    "pareto_top_10": f"""WITH {NATION_SQL} SELECT label, round(value, 2) AS value, round(value/total*100, 6) AS pct, round(run/total*100, 6) AS cumulative_pct,
 (run - value)/total*100 < 80 AS in_80 FROM r ORDER BY r.value DESC LIMIT 10""",
    "pareto_many_categories": """WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS label, sum(o_totalprice) AS value FROM orders GROUP BY 1),
r AS (SELECT *, sum(value) OVER (ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING) AS run, sum(value) OVER () AS total FROM s)
SELECT label, round(value, 2) AS value, round(value/total*100, 5) AS pct, round(run/total*100, 5) AS cumulative_pct, (run - value)/total*100 < 80 AS in_80 FROM r""",
    "cohort_retention": f"""WITH {COHORT_SQL} SELECT printf('%04d-%02d', c // 12, c % 12 + 1) AS cohort, period, users, cohort_size, round(users*100.0::DOUBLE/cohort_size, 6) AS retention_pct FROM grid""",
    "cohort_auto_columns": f"WITH {COHORT_SQL} SELECT period, CAST(sum(users) AS BIGINT) AS users FROM grid GROUP BY period",
    "zscore_summary": f"""WITH z AS (SELECT {Z_SQL.format(c="value")} AS a, {Z_SQL.format(c="user_id")} AS b FROM events)
 SELECT '(any)' AS "column", count(*) FILTER (greatest(a, b) > 3) AS anomalies FROM z
 UNION ALL SELECT 'value', count(*) FILTER (a > 3) FROM z HAVING count(*) FILTER (a > 3) > 0
 UNION ALL SELECT 'user_id', count(*) FILTER (b > 3) FROM z HAVING count(*) FILTER (b > 3) > 0""",
    "zscore_top": f"SELECT event_id, round({Z_SQL.format(c='value')}, 6) AS max_z FROM events ORDER BY {Z_SQL.format(c='value')} DESC, event_id LIMIT 10",
    "zscore_top_many_columns": f"""SELECT o_orderkey, round(z, 6) AS max_z FROM (SELECT o_orderkey, greatest({Z_SQL.format(c='o_totalprice')}, {Z_SQL.format(c='o_custkey')}) AS z FROM orders)
 ORDER BY z DESC, o_orderkey LIMIT 10""",
    "zscore_histogram": f"""WITH z AS (SELECT {Z_SQL.format(c="value")} AS z FROM events), e AS (SELECT min(z) AS lo, (max(z) - min(z))/50 AS w FROM z)
 SELECT bin, round(lo + bin*w, 5) AS low, round(lo + bin*w + w, 5) AS high, count(*) AS count
 FROM (SELECT least(CAST(floor((z - lo)/w) AS BIGINT), 49) AS bin, lo, w FROM z, e) GROUP BY bin, lo, w""",
    "basket_itemsets": f"""{_basket_sql(LINES)} SELECT array_to_string(items, ',') AS items, len(items) AS length, f AS freq, round(s, 6) AS support, CAST(n AS BIGINT) AS transactions FROM sets""",
    "basket_rules": f"{_basket_sql(LINES)} {RULE_COLUMNS} WHERE confidence >= 0.1",
    "basket_event_rules": f"{_basket_sql(EVENT_LINES)} {RULE_COLUMNS} WHERE confidence >= 0.3 AND lift >= 1",
    "basket_top_rules": f"""{_basket_sql(EVENT_LINES)} SELECT antecedent, consequent, lift FROM ({RULE_COLUMNS} WHERE confidence >= 0.3 AND lift >= 1
 ORDER BY rule.lift DESC, rule.confidence DESC, ai, ci LIMIT 15)""",
}
