"""Linear, polynomial and logistic regression with hold-out metrics."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from statloom.functions.ordered import prefix_sum
from statloom.roles import number, quoted, roles

TEST_PERCENT = 20


def split_flag(key: str | None, columns: list[str]) -> Column:
    """True for test rows: a hash of the key (or of the used values) below 20 %.

    It needs no shuffle, is stable across partitions and can be repeated in any SQL engine.
    """
    if key is not None:
        text = quoted(key).cast("string")
    else:
        text = F.concat_ws("|", *[quoted(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100 < TEST_PERCENT


def prepare(df: DataFrame, target: str, features: list[str], key: str | None = None) -> DataFrame:
    """Complete rows as (key, y, x0..xk, is_test)."""
    names = [f"x{i}" for i in range(len(features))]
    chosen = df.select(
        (quoted(key) if key else F.lit(None)).alias("key"),
        number(target).alias("y"),
        *[number(c).alias(n) for n, c in zip(names, features)],
        split_flag(key, [target, *features]).alias("is_test"),
    )
    return chosen.dropna(subset=["y", *names])


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """XᵀX of the columns (k × k sums from one aggregation)."""
    k = len(columns)
    sums = [
        F.sum(quoted(columns[i]) * quoted(columns[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)
    ]
    r = df.agg(*sums).first()
    return np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], dtype=float)


def default_columns(df: DataFrame, params: dict) -> tuple[str, list[str]]:
    numeric = roles(df).numeric
    target = params.get("target_column") or (numeric[-1] if numeric else None)
    features = params.get("feature_columns") or [c for c in numeric if c != target]
    if not target or not features:
        raise ValueError("regression needs a target and feature columns")
    return target, features


def _assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows)


def linear_fit(df: DataFrame, target: str, features: list[str], key: str | None = None) -> dict[str, DataFrame]:
    """Ordinary least squares on the training rows.

    ``coefficients``: name, coefficient, std_error, t_value, p_value. ``predictions``: key, actual,
    predicted over the test rows. ``metrics``: r2, rmse, mae, train_size, test_size.
    """
    spark = df.sparkSession
    names = [f"x{i}" for i in range(len(features))]
    rows = _assembled(prepare(df, target, features, key), names).select("key", "y", "features", "is_test")
    train = rows.where(~F.col("is_test"))
    model = LinearRegression(labelCol="y", solver="normal", regParam=0.0).fit(train)
    summary = model.summary
    weights = list(map(float, model.coefficients)) + [float(model.intercept)]
    try:
        errors, ts, ps = (list(map(float, v)) for v in (
            summary.coefficientStandardErrors, summary.tValues, summary.pValues))
    except Exception:  # a singular design has no standard errors
        errors = ts = ps = [None] * len(weights)
    coefficients = spark.createDataFrame(
        list(zip([*features, "(intercept)"], weights, errors, ts, ps)),
        "name string, coefficient double, std_error double, t_value double, p_value double",
    )
    w = model.coefficients
    dot = sum(
        (F.lit(float(w[i])) * F.col("xs")[i] for i in range(len(features))), F.lit(float(model.intercept))
    )
    predictions = (
        rows.where("is_test")
        .withColumn("xs", vector_to_array("features"))
        .select("key", F.col("y").alias("actual"), dot.alias("predicted"))
    )
    sizes = F.lit(int(summary.numInstances)).cast("long")
    return {
        "coefficients": coefficients,
        "predictions": predictions,
        "metrics": regression_metrics(predictions).withColumn("train_size", sizes),
    }


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """R² about the test mean, RMSE and MAE of (actual, predicted) rows."""
    error = F.col("actual") - F.col("predicted")
    sums = predictions.agg(
        F.count("*").alias("test_size"),
        F.sum(error**2).alias("_sse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.var_pop("actual") * F.count("*")).alias("_sst"),
    )
    return sums.select(
        F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).alias("r2"),
        F.sqrt(F.try_divide(F.col("_sse"), F.col("test_size"))).alias("rmse"),
        "mae",
        "test_size",
    )


def top_coefficients(coefficients: DataFrame, k: int = 5) -> DataFrame:
    return (
        coefficients.where("name <> '(intercept)'").orderBy(F.desc(F.abs("coefficient")), "name").limit(k)
    )


def polynomial_fit(df: DataFrame, target: str, feature: str, key: str | None = None) -> dict[str, DataFrame]:
    """Degrees 2 to 4 of one feature; the best test R² wins.

    The feature is centred and scaled, all power sums come from one pass, and the three small normal
    equations are solved from them; coefficients are mapped back to the raw feature.
    """
    spark = df.sparkSession
    rows = prepare(df, target, [feature], key)
    m = rows.where(~F.col("is_test")).agg(F.avg("x0").alias("m"), F.stddev_pop("x0").alias("s")).first()
    if m["m"] is None:
        raise ValueError("polynomial regression needs complete rows")
    centre, scale = float(m["m"]), float(m["s"] or 1.0) or 1.0
    z = (F.col("x0") - centre) / scale
    train = rows.where(~F.col("is_test")).select(z.alias("z"), "y")
    sums = [F.sum(F.col("z") ** i).alias(f"p{i}") for i in range(9)]
    sums += [F.sum(F.col("z") ** i * F.col("y")).alias(f"q{i}") for i in range(5)]
    r = train.agg(*sums).first()
    fits = []
    for degree in (2, 3, 4):
        a = np.array([[r[f"p{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)], dtype=float)
        b = np.array([r[f"q{i}"] for i in range(degree + 1)], dtype=float)
        fits.append((degree, np.linalg.lstsq(a, b, rcond=None)[0]))
    curves = []
    for degree, beta in fits:
        zc: Column = reduce(lambda acc, c: acc * z + float(c), reversed(beta[:-1]), F.lit(float(beta[-1])))
        curves.append(F.struct(F.lit(degree).alias("degree"), zc.alias("predicted")))
    predictions = rows.where("is_test").select(
        "key", F.col("x0").alias("feature"), F.col("y").alias("actual"), F.inline(F.array(*curves))
    )
    error = F.col("actual") - F.col("predicted")
    metrics = predictions.groupBy("degree").agg(
        (1 - F.try_divide(F.sum(error**2), F.var_pop("actual") * F.count("*"))).alias("r2"),
        F.sqrt(F.avg(error**2)).alias("rmse"),
        F.count("*").alias("test_size"),
    )
    out = []
    for degree, beta in fits:
        raw = np.poly1d(beta[::-1])(np.poly1d([1 / scale, -centre / scale])).coeffs[::-1]
        for power in range(degree + 1):
            out.append((degree, power, float(raw[power]) if power < len(raw) else 0.0))
    coefficients = spark.createDataFrame(out, "degree int, power int, coefficient double")
    best = metrics.agg(F.max_by("degree", F.struct("r2", -F.col("degree"))).alias("best_degree"))
    return {"metrics": metrics, "coefficients": coefficients, "predictions": predictions, "best": best}


def binary_target(df: DataFrame, numeric: list[str]) -> str | None:
    """First numeric column whose values are only 0 and 1."""
    facts = [F.coalesce(F.bool_and(number(c).isin(0.0, 1.0)), F.lit(False)).alias(f"b{i}") for i, c in enumerate(numeric)]
    row = df.agg(*facts).first()
    return next((c for i, c in enumerate(numeric) if row[i]), None)


def logistic_fit(df: DataFrame, target: str, features: list[str], key: str | None = None) -> dict[str, DataFrame]:
    """L2 logistic regression with unit penalty strength; scores, confusion, ROC and metrics on test rows."""
    spark = df.sparkSession
    names = [f"x{i}" for i in range(len(features))]
    rows = _assembled(prepare(df, target, features, key), names).select("key", "y", "features", "is_test").persist()
    train = rows.where(~F.col("is_test"))
    n_train = max(1, train.count())
    # Spark minimises mean loss + λ/2·|w|², so λ = 1/n is a penalty strength of one.
    model = LogisticRegression(
        labelCol="y", regParam=1.0 / n_train, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-9
    ).fit(train)
    scored = model.transform(rows.where("is_test")).select(
        "key",
        F.col("y").cast("int").alias("label"),
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("predicted"),
    )
    coefficients = spark.createDataFrame(
        [*zip(features, map(float, model.coefficients)), ("(intercept)", float(model.intercept))],
        "name string, coefficient double",
    )
    return {
        "coefficients": coefficients,
        "scores": scored,
        "confusion": confusion_matrix(scored),
        "roc": roc_curve(scored),
        "metrics": classification_metrics(scored),
    }


def confusion_matrix(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label", "predicted").agg(F.count("*").alias("count"))


def _score_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")
    )


def roc_curve(scored: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr), a row per distinct score from the highest down."""
    run = prefix_sum(
        _score_counts(scored), ["score"], {"_tp": "p", "_fp": "n"}, [], {"_p": "p", "_n": "n"}, descending_first=True
    )
    return run.select(
        F.col("score").alias("threshold"),
        F.when(F.col("_n") > 0, F.col("_fp") / F.col("_n")).alias("fpr"),
        F.when(F.col("_p") > 0, F.col("_tp") / F.col("_p")).alias("tpr"),
    )


def classification_metrics(scored: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 (0 when undefined) and AUC by pairs won, ties half."""
    hit = lambda a, b: F.count_if((F.col("label") == a) & (F.col("predicted") == b)).cast("double")
    counts = scored.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    run = prefix_sum(_score_counts(scored), ["score"], {"_below": "n"}, [], {"_p": "p", "_n": "n"})
    auc = run.agg(
        F.try_divide(
            F.sum(F.col("p") * (F.col("_below") - F.col("n") + F.col("n") / 2.0)),
            (F.max("_p") * F.max("_n")).cast("double"),
        ).alias("auc")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumn("auc", auc.scalar()).select(
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        "auc",
        (tp + tn + fp + fn).cast("long").alias("test_size"),
    )


def vif(df: DataFrame, features: list[str]) -> DataFrame:
    """(column, vif) without a constant: VIFᵢ = (XᵀX)ᵢᵢ · (XᵀX)⁻¹ᵢᵢ."""
    rows = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(features)]).dropna()
    g = gram(rows, rows.columns)
    # Scaling to a unit diagonal keeps the inverse well conditioned and leaves the product unchanged.
    d = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    unit = g / np.outer(d, d)
    values = np.diag(np.linalg.pinv(unit)) if np.linalg.matrix_rank(unit) == len(features) else [float("inf")] * len(features)
    return df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(features, values)], "column string, vif double"
    )


