"""Registered queries: regression, time series, clustering, dimensionality."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.support import DAILY_SQL, daily_orders, rounded, table
from statloom.operators import cluster, regression, series

EMBEDDING_WIDTH = 64


def _lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("line_key", F.col("l_orderkey") * 100 + F.col("l_linenumber"))


def _price_fit(spark, sf):
    return regression.linear_fit(_lines(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"], "line_key")


def split(spark, sf):
    df = table(spark, sf, "customer")
    return df.select("c_custkey", regression.split_flag("c_custkey", []).alias("is_test"))


def linear_coefficients(spark, sf):
    return rounded(_price_fit(spark, sf)["coefficients"].select("name", "coefficient"), 3)


def linear_metrics(spark, sf):
    return rounded(_price_fit(spark, sf)["metrics"], 6, rmse=3, mae=3)


def linear_p_values(spark, sf):
    return rounded(_price_fit(spark, sf)["coefficients"], 4)


def linear_predictions(spark, sf):
    return rounded(_price_fit(spark, sf)["predictions"].withColumnRenamed("key", "line_key"), 2)


def linear_top(spark, sf):
    return rounded(regression.top_coefficients(_price_fit(spark, sf)["coefficients"].select("name", "coefficient")), 3)


def polynomial(spark, sf):
    fit = regression.polynomial_fit(table(spark, sf, "part"), "p_retailprice", "p_size", "p_partkey")
    return rounded(fit["metrics"].withColumn("best_degree", fit["best"].scalar()), 6)


def polynomial_quadratic(spark, sf):
    fit = regression.polynomial_fit(table(spark, sf, "part"), "p_retailprice", "p_size", "p_partkey")
    return rounded(fit["coefficients"].where("degree = 2").select("power", "coefficient"), 5)


def polynomial_curve(spark, sf):
    fit = regression.polynomial_fit(table(spark, sf, "part"), "p_retailprice", "p_size", "p_partkey")
    return rounded(fit["predictions"].where("degree = 2").select("key", "feature", "actual", "predicted"), 4)


def _labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")


def logistic(spark, sf):
    df = _labelled(spark, sf).withColumn("k_chars", F.col("n_chars") / 1000.0)
    return rounded(regression.logistic_fit(df, "quality", ["k_chars", "toxic"], "doc_id")["metrics"])


def logistic_coefficients(spark, sf):
    df = _labelled(spark, sf).withColumn("k_chars", F.col("n_chars") / 1000.0)
    return rounded(regression.logistic_fit(df, "quality", ["k_chars", "toxic"], "doc_id")["coefficients"], 4)


def _fixed_scores(spark, sf):
    return _labelled(spark, sf).select(
        F.col("quality").alias("label"),
        F.round(F.col("n_chars") / 40000.0, 3).alias("score"),
        (F.col("n_chars") > 1500).cast("int").alias("predicted"),
    )


def roc(spark, sf):
    return rounded(regression.roc_curve(_fixed_scores(spark, sf)))


def confusion(spark, sf):
    return rounded(regression.confusion_matrix(_fixed_scores(spark, sf)))


def metrics(spark, sf):
    return rounded(regression.classification_metrics(_fixed_scores(spark, sf)))


def vif(spark, sf):
    return rounded(regression.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]))


def daily_sum(spark, sf):
    return rounded(series.aggregate_by_date(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"), 2)


def daily_mean(spark, sf):
    df = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "value")
    return rounded(series.aggregate_by_date(df, "day", "value"))


def _daily(spark, sf):
    return series.aggregate_by_date(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


def gaps(spark, sf):
    return rounded(series.date_gaps(table(spark, sf, "lineitem"), "l_shipdate"))


def months(spark, sf):
    return rounded(series.month_summary(_daily(spark, sf), "y"), 4)


def peak_low(spark, sf):
    return rounded(series.peak_and_low(series.month_summary(_daily(spark, sf), "y")))


def adf_lag_1(spark, sf):
    return rounded(series.adf(_daily(spark, sf), lags=1).select("adf_stat", "lags", "nobs"), 5)


def adf(spark, sf):
    return rounded(series.adf(_daily(spark, sf)))


def granger_lag_1(spark, sf):
    out = series.granger(daily_orders(spark, sf), "day", "total_price", "order_count", 1)
    return rounded(out, 5)


def granger(spark, sf):
    return rounded(series.granger(daily_orders(spark, sf), "day", "total_price", "order_count"))


def _by_status(spark, sf):
    df = table(spark, sf, "orders").withColumn("week", F.date_trunc("week", F.col("o_orderdate")).cast("date"))
    return series.aggregate_by_date(df, "week", "o_totalprice", ["o_orderstatus"])


def arima_orders(spark, sf):
    best = series.arima(_by_status(spark, sf), ["o_orderstatus"])
    return rounded(best.drop("forecast"), 3)


def arima_forecast(spark, sf):
    best = series.arima(_by_status(spark, sf), ["o_orderstatus"])
    return rounded(series.arima_forecast(best, ["o_orderstatus"]), 2)


AR1 = ((1, 0, 0),)


def arima_ar1_orders(spark, sf):
    best = series.arima(_by_status(spark, sf), ["o_orderstatus"], orders=AR1)
    return rounded(best.drop("forecast"), 3)


def arima_ar1_forecast(spark, sf):
    best = series.arima(_by_status(spark, sf), ["o_orderstatus"], orders=AR1)
    return rounded(series.arima_forecast(best, ["o_orderstatus"]), 0)


def additive(spark, sf):
    return rounded(series.additive_forecast(_daily(spark, sf)).where("is_future"), 2)


def additive_summary(spark, sf):
    return rounded(series.forecast_summary(series.additive_forecast(_daily(spark, sf))), 2)


def additive_parts(spark, sf):
    return rounded(series.additive_forecast(_daily(spark, sf)).select("ds", "trend", "weekly", "yearly"), 2)


def _embeddings(spark, sf):
    return cluster.expand_array(table(spark, sf, "embeddings"), "embedding", EMBEDDING_WIDTH, "e")


EMBEDDING_COLUMNS = [f"e{i}" for i in range(EMBEDDING_WIDTH)]


def standardised(spark, sf):
    df = cluster.standardised(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"])
    return rounded(df.select("c_custkey", F.col("xs")[0].alias("balance"), F.col("xs")[1].alias("nation")))


def kmeans_elbow(spark, sf):
    return rounded(cluster.kmeans(_embeddings(spark, sf), EMBEDDING_COLUMNS, ["vec_id"])["elbow"], 3)


def kmeans_sizes(spark, sf):
    return rounded(cluster.kmeans(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"])["sizes"])


def kmeans_metrics(spark, sf):
    return rounded(cluster.kmeans(table(spark, sf, "part"), ["p_size", "p_retailprice"], ["p_partkey"])["metrics"])


def kmeans_projection(spark, sf):
    return rounded(cluster.kmeans(_embeddings(spark, sf), EMBEDDING_COLUMNS, ["vec_id"], k=10)["projection"])


def hierarchical(spark, sf):
    return rounded(cluster.hierarchical(table(spark, sf, "part"), ["p_size", "p_retailprice"], ["p_partkey"])["sizes"])


def size_shares(spark, sf):
    return rounded(cluster.cluster_sizes(table(spark, sf, "embeddings").withColumnRenamed("label", "cluster")))


def label_centroids(spark, sf):
    df = table(spark, sf, "part").select(
        F.col("p_brand").alias("cluster"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("xs")
    )
    return rounded(cluster.centroids(df, ["p_size", "p_retailprice"]), 4)


def pca_variance(spark, sf):
    return rounded(cluster.pca(_embeddings(spark, sf), EMBEDDING_COLUMNS)["variance"])


def pca_scores(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(cluster.pca(table(spark, sf, "lineitem"), columns, ["l_orderkey", "l_linenumber"])["scores"])


QUERIES = {
    "hash_split": split,
    "linear_regression": linear_coefficients,
    "linear_regression_metrics": linear_metrics,
    "linear_regression_p_values": linear_p_values,
    "linear_regression_predictions": linear_predictions,
    "linear_regression_top_coefficients": linear_top,
    "polynomial_regression": polynomial,
    "polynomial_quadratic": polynomial_quadratic,
    "polynomial_fitted_curve": polynomial_curve,
    "logistic_regression": logistic,
    "logistic_coefficients": logistic_coefficients,
    "roc_curve": roc,
    "confusion_matrix": confusion,
    "classification_metrics": metrics,
    "vif": vif,
    "daily_sum": daily_sum,
    "daily_mean": daily_mean,
    "date_gaps": gaps,
    "month_summary": months,
    "peak_and_low_month": peak_low,
    "adf_lag_1": adf_lag_1,
    "adf": adf,
    "granger_lag_1": granger_lag_1,
    "granger": granger,
    "arima_orders": arima_orders,
    "arima_forecast": arima_forecast,
    "arima_ar1_orders": arima_ar1_orders,
    "arima_ar1_forecast": arima_ar1_forecast,
    "additive_forecast": additive,
    "additive_summary": additive_summary,
    "additive_components": additive_parts,
    "standardised_columns": standardised,
    "kmeans_elbow": kmeans_elbow,
    "kmeans_sizes": kmeans_sizes,
    "kmeans_metrics": kmeans_metrics,
    "kmeans_projection": kmeans_projection,
    "hierarchical_sizes": hierarchical,
    "cluster_size_shares": size_shares,
    "cluster_centroids": label_centroids,
    "pca_variance": pca_variance,
    "pca_scores": pca_scores,
}


def _split(key: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 20"


def _two_features(source: str, y: str, a: str, b: str) -> str:
    """CTEs solving y on a and b (with intercept) over the training rows of ``source`` (y, a, b, is_test)."""
    return f"""d AS (SELECT {y} AS y, {a} AS a, {b} AS b, is_test, key FROM {source}),
m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab,
 covar_pop(a, y) AS say, covar_pop(b, y) AS sby, count(*) AS n FROM d WHERE NOT is_test),
c AS (SELECT *, (sbb*say - sab*sby)/(saa*sbb - sab*sab) AS ca, (saa*sby - sab*say)/(saa*sbb - sab*sab) AS cb FROM m),
w AS (SELECT *, my - ca*ma - cb*mb AS c0 FROM c),
pr AS (SELECT key, a, y, c0 + ca*a + cb*b AS yhat FROM d, w WHERE is_test)"""


LINES_SQL = f"src AS (SELECT *, l_orderkey*100 + l_linenumber AS key, {_split('l_orderkey*100 + l_linenumber')} AS is_test FROM lineitem)"
LINEAR_SQL = f"WITH {LINES_SQL}, {_two_features('src', 'l_extendedprice', 'l_quantity', 'l_discount')}"
PART_SQL = f"src AS (SELECT p_retailprice AS y, p_size::DOUBLE AS a, power(p_size, 2)::DOUBLE AS b, p_partkey AS key, {_split('p_partkey')} AS is_test FROM part)"
QUAD_SQL = f"WITH {PART_SQL}, {_two_features('src', 'y', 'a', 'b')}"

SCORES_SQL = """sc AS (SELECT quality AS label, round(n_chars/40000.0::DOUBLE, 3) AS score, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS predicted
 FROM labels JOIN documents USING (doc_id))"""


def _regress_two(dep: str, x1: str, x2: str, source: str) -> str:
    return f"""m AS (SELECT count(*) AS n, var_pop({dep})*count(*) AS syy, var_pop({x1})*count(*) AS s11, var_pop({x2})*count(*) AS s22,
 covar_pop({x1}, {x2})*count(*) AS s12, covar_pop({x1}, {dep})*count(*) AS s1y, covar_pop({x2}, {dep})*count(*) AS s2y FROM {source}),
e AS (SELECT *, s11*s22 - s12*s12 AS det, (s22*s1y - s12*s2y)/(s11*s22 - s12*s12) AS b1, (s11*s2y - s12*s1y)/(s11*s22 - s12*s12) AS b2 FROM m),
sse AS (SELECT *, syy - b1*s1y - b2*s2y AS sse FROM e)"""


from checks.support import f_tail  # noqa: E402

# AR(1) with a constant by least squares over weekly sums per status; the forecast recursion as in the operator.
AR1_SQL = """WITH RECURSIVE s AS (
  SELECT o_orderstatus, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS ds, sum(o_totalprice)::DOUBLE AS y
  FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY ALL
), l AS (
  SELECT *, lag(y) OVER w AS y1, epoch_us(ds) - lag(epoch_us(ds)) OVER w AS gap FROM s WINDOW w AS (PARTITION BY o_orderstatus ORDER BY ds)
), f AS (
  SELECT o_orderstatus, regr_intercept(y, y1) AS c, regr_slope(y, y1) AS phi, regr_count(y, y1) AS n,
    greatest(regr_syy(y, y1) - regr_sxy(y, y1) * regr_sxy(y, y1) / regr_sxx(y, y1), 0) AS rss,
    arg_max(y, ds) AS y_last, epoch_us(max(ds)) AS last_us, coalesce(median(gap), 86400000000) AS gap
  FROM l GROUP BY 1 HAVING regr_count(y, y1) >= 7 AND abs(regr_slope(y, y1)) < 0.999
), r(o_orderstatus, step, m, psi, cum) AS (
  SELECT o_orderstatus, 1, c + phi * y_last, 1.0::DOUBLE, 1.0::DOUBLE FROM f
  UNION ALL
  SELECT r.o_orderstatus, step + 1, c + phi * m, phi * psi, cum + (phi * psi) * (phi * psi) FROM r JOIN f USING (o_orderstatus) WHERE step < 30
)"""

# Standard errors from the centred 2 x 2 system; p of |t| by F(1, dof), and 0 beyond |t| = 8 (below 1e-6 at these sizes).
LINEAR_P_SQL = f"""{LINEAR_SQL},
r AS (SELECT sum(power(y - c0 - ca*a - cb*b, 2)) / (count(*) - 3) AS s2, count(*) - 3 AS dof FROM d, w WHERE NOT is_test),
se AS (SELECT s2, dof, ca, cb, c0, sqrt(s2 * sbb / (n * (saa*sbb - sab*sab))) AS sa, sqrt(s2 * saa / (n * (saa*sbb - sab*sab))) AS sb,
  sqrt(s2 * (1.0/n + (ma*ma*sbb - 2*ma*mb*sab + mb*mb*saa) / (n * (saa*sbb - sab*sab)))) AS s0 FROM w, r),
co AS (SELECT 1 AS id, 'l_quantity' AS name, ca AS coefficient, sa AS std_error, dof FROM se
  UNION ALL SELECT 2, 'l_discount', cb, sb, dof FROM se UNION ALL SELECT 3, '(intercept)', c0, s0, dof FROM se),
ts AS (SELECT *, coefficient / std_error AS t FROM co),
f0 AS (SELECT id, t*t AS f, 1.0::DOUBLE AS d1, dof::DOUBLE AS d2 FROM ts WHERE abs(t) <= 8), {f_tail("f0")}
SELECT name, round(coefficient, 4) + 0.0 AS coefficient, round(std_error, 4) + 0.0 AS std_error, round(t, 4) + 0.0 AS t_value,
  round(CASE WHEN abs(t) > 8 THEN 0.0 ELSE (SELECT p FROM ft WHERE ft.id = ts.id) END, 4) + 0.0 AS p_value FROM ts"""

ORACLES = {
    "linear_regression_p_values": LINEAR_P_SQL,
    "arima_ar1_orders": f"""{AR1_SQL}
 SELECT o_orderstatus, 1 AS p, 0 AS d, 0 AS q, round(n * (ln(2 * pi() * (rss / n)) + 1) + 6, 3) + 0.0 AS aic, round(sqrt(rss / n), 3) + 0.0 AS rmse FROM f""",
    "arima_ar1_forecast": f"""{AR1_SQL}
 SELECT o_orderstatus, step, make_timestamp(last_us + CAST(floor(gap * step) AS BIGINT)) AS ds, round(m, 0) + 0.0 AS yhat,
   round(m - 1.959963984540054 * sqrt(rss / n * cum), 0) + 0.0 AS yhat_lower, round(m + 1.959963984540054 * sqrt(rss / n * cum), 0) + 0.0 AS yhat_upper
 FROM r JOIN f USING (o_orderstatus)""",
    "hash_split": f"SELECT c_custkey, {_split('c_custkey')} AS is_test FROM customer",
    "linear_regression": f"""{LINEAR_SQL} SELECT 'l_quantity' AS name, round(ca, 3) AS coefficient FROM w UNION ALL SELECT 'l_discount', round(cb, 3) FROM w
 UNION ALL SELECT '(intercept)', round(c0, 3) FROM w""",
    "linear_regression_metrics": f"""{LINEAR_SQL} SELECT round(1 - sum(power(y-yhat, 2))/(var_pop(y)*count(*)), 6) AS r2, round(sqrt(avg(power(y-yhat, 2))), 3) AS rmse,
 round(avg(abs(y-yhat)), 3) AS mae, count(*) AS test_size, (SELECT n FROM w) AS train_size FROM pr""",
    "linear_regression_predictions": f"{LINEAR_SQL} SELECT key AS line_key, round(y, 2) AS actual, round(yhat, 2) AS predicted FROM pr",
    "linear_regression_top_coefficients": f"{LINEAR_SQL} SELECT 'l_quantity' AS name, round(ca, 3) AS coefficient FROM w UNION ALL SELECT 'l_discount', round(cb, 3) FROM w",
    "polynomial_quadratic": f"{QUAD_SQL} SELECT 0 AS power, round(c0, 5) AS coefficient FROM w UNION ALL SELECT 1, round(ca, 5) FROM w UNION ALL SELECT 2, round(cb, 5) FROM w",
    "polynomial_fitted_curve": f"{QUAD_SQL} SELECT key, round(a, 4) AS feature, round(y, 4) AS actual, round(yhat, 4) AS predicted FROM pr",
    "roc_curve": f"""WITH {SCORES_SQL}, g AS (SELECT score, sum(label) AS p, sum(1-label) AS n FROM sc GROUP BY 1)
 SELECT round(score, 6) AS threshold, round(sum(n) OVER w / sum(n) OVER ()::DOUBLE, 6) AS fpr, round(sum(p) OVER w / sum(p) OVER ()::DOUBLE, 6) AS tpr
 FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""",
    "confusion_matrix": f"WITH {SCORES_SQL} SELECT label, predicted, count(*) AS count FROM sc GROUP BY 1, 2",
    "classification_metrics": f"""WITH {SCORES_SQL}, c AS (SELECT count(*) AS n, (count(*) FILTER (label=1 AND predicted=1))::DOUBLE AS tp, (count(*) FILTER (label=0 AND predicted=1))::DOUBLE AS fp,
 (count(*) FILTER (label=1 AND predicted=0))::DOUBLE AS fn, (count(*) FILTER (label=0 AND predicted=0))::DOUBLE AS tn FROM sc),
 a AS (SELECT avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END::DOUBLE) AS auc FROM sc x, sc y WHERE x.label = 1 AND y.label = 0)
 SELECT round((tp+tn)/n, 6) AS accuracy, round(tp/(tp+fp), 6) AS precision, round(tp/(tp+fn), 6) AS recall, round(2*tp/(2*tp+fp+fn), 6) AS f1, round(auc, 6) AS auc, n AS test_size FROM c, a""",
    "vif": """WITH g AS (SELECT sum(l_quantity*l_quantity) AS a, sum(l_quantity*l_discount) AS b, sum(l_discount*l_discount) AS c FROM lineitem)
 SELECT unnest(['l_quantity', 'l_discount']) AS "column", round(a*c/(a*c - b*b), 6) AS vif FROM g""",
    "daily_sum": "SELECT o_orderdate AS ds, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1",
    "daily_mean": "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ds, round(avg(value), 6) AS y FROM events GROUP BY 1",
    "date_gaps": """WITH g AS (SELECT date_diff('day', lag(l_shipdate) OVER (ORDER BY l_shipdate), l_shipdate)::DOUBLE AS gap FROM lineitem)
 SELECT count(*) AS n, round(median(gap), 6) AS median_gap, round(max(gap), 6) AS max_gap FROM g""",
    "month_summary": f"WITH {DAILY_SQL} SELECT month(day) AS month, round(avg(total_price), 4) AS mean_value FROM daily GROUP BY 1",
    "peak_and_low_month": f"""WITH {DAILY_SQL}, m AS (SELECT month(day) AS month, avg(total_price) AS v FROM daily GROUP BY 1)
 SELECT arg_max(month, v) AS peak_month, arg_min(month, v) AS low_month FROM m""",
    "adf_lag_1": f"""WITH {DAILY_SQL}, l AS (SELECT total_price AS y0, lag(total_price, 1) OVER o AS y1, lag(total_price, 2) OVER o AS y2 FROM daily WINDOW o AS (ORDER BY day)),
 r AS (SELECT y0 - y1 AS dy, y1, y1 - y2 AS d1 FROM l WHERE y2 IS NOT NULL), {_regress_two('dy', 'y1', 'd1', 'r')}
 SELECT round(b1/sqrt(sse/(n-3)*s22/det), 5) AS adf_stat, 1 AS lags, n AS nobs FROM sse""",
    "granger_lag_1": f"""WITH {DAILY_SQL}, l AS (SELECT total_price AS y0, lag(total_price) OVER o AS y1, lag(order_count) OVER o AS x1 FROM daily WINDOW o AS (ORDER BY day)),
 r AS (SELECT * FROM l WHERE y1 IS NOT NULL), {_regress_two('y0', 'y1', 'x1', 'r')},
 g AS (SELECT 1 AS lag, ((syy - s1y*s1y/s11) - sse)/(sse/(n+1-4)) AS f, n + 1 - 4 AS dof FROM sse),
 f0 AS (SELECT 1 AS id, f, 1.0::DOUBLE AS d1, dof::DOUBLE AS d2 FROM g), {f_tail("f0")}
 SELECT lag, round(g.f, 5) AS f_stat, dof, round(p, 5) AS p_value FROM g, ft""",
    "standardised_columns": """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ())/stddev_pop(c_acctbal) OVER (), 6) AS balance,
 round((c_nationkey - avg(c_nationkey) OVER ())/stddev_pop(c_nationkey) OVER (), 6) AS nation FROM customer""",
    "cluster_size_shares": "SELECT label AS cluster, count(*) AS size, round(count(*)/sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM embeddings GROUP BY 1",
    "cluster_centroids": " UNION ALL ".join(
        f"""SELECT p_brand AS cluster, '{c}' AS "column", round(avg({c}), 4) AS mean, round(var_pop({c}), 4) AS variance FROM part GROUP BY 1"""
        for c in ("p_size", "p_retailprice")
    ),
}
