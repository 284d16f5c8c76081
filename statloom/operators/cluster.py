"""K-means with elbow choice, Ward clustering on micro-clusters, cluster facts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from statloom.roles import number, quoted
from statloom.session import cut_lineage

SEED = 42
MICRO_CLUSTERS = 200
WARD_CLUSTERS = 4
PARALLEL_FITS = 9


def standardised(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Complete rows as ``keep`` columns plus ``xs``, the population z-scaled values as an array.

    Listwise deletion comes first; a constant column keeps its centred zeros.
    """
    raw = F.array(*[number(c) for c in columns]).alias("raw")
    # The chosen numbers are written once: every caller reads them many times, and a filter on the
    # stored array keeps Catalyst's constraints small where a filter on many expressions would not.
    stored = cut_lineage(df.select(*[quoted(k) for k in (keep or [])], raw))
    rows = stored.where(F.forall("raw", lambda x: x.isNotNull()))
    # Two numbers per column as literals, and one array column: the plan stays short for wide tables.
    each = range(len(columns))
    facts = rows.agg(*[F.avg(F.col("raw")[i]) for i in each], *[F.stddev_pop(F.col("raw")[i]) for i in each]).first()
    means = F.array(*[F.lit(float(v or 0.0)) for v in facts[: len(columns)]])
    deviations = F.array(*[F.lit(float(v or 0.0) or 1.0) for v in facts[len(columns) :]])
    scaled = F.transform("raw", lambda x, i: (x - F.get(means, i)) / F.get(deviations, i))
    return rows.select(*[quoted(k) for k in (keep or [])], scaled.alias("xs"))


def expand_array(df: DataFrame, column: str, width: int, prefix: str = "d") -> DataFrame:
    """The elements of an array column as numeric columns."""
    rest = [quoted(c) for c in df.columns if c != column]
    return df.select(*rest, *[quoted(column)[i].cast("double").alias(f"{prefix}{i}") for i in range(width)])


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector("xs"))


def elbow_k(inertias: list[float], k_max: int) -> int:
    """k of the largest second difference of the inertias, kept inside 2 .. k_max − 1."""
    if len(inertias) < 3:
        return 3
    bend = int(np.argmax(np.diff(inertias, 2))) + 2
    return max(2, min(bend, k_max - 1))


def _fit(vectors: DataFrame, k: int, seed: int = SEED):
    return KMeans(k=k, seed=seed, featuresCol="features").fit(vectors)


def _fit_all(vectors: DataFrame, tasks: list[tuple[int, int]]) -> list:
    """Independent fits over the same cached rows, submitted together."""
    with ThreadPoolExecutor(max_workers=max(1, min(PARALLEL_FITS, len(tasks)))) as pool:
        return list(pool.map(lambda task: _fit(vectors, *task), tasks))


def kmeans(df: DataFrame, columns: list[str], keep: list[str] | None = None, k: int | None = None) -> dict[str, DataFrame]:
    """``elbow`` (k, inertia), ``assignments``, ``sizes``, ``metrics`` (k, silhouette), ``projection``, ``centroids``.

    The standardised vectors are cached once for all fits. The silhouette is the mean over rows
    with squared Euclidean distances, which Spark computes in one pass over the rows.
    """
    spark = df.sparkSession
    vectors = _vectors(standardised(df, columns, keep)).persist()
    n = vectors.count()
    ks = list(range(2, min(11, n))) if k is None else []
    inertias = [float(m.summary.trainingCost) for m in _fit_all(vectors, [(i, SEED) for i in ks])]
    best = k or elbow_k(inertias, ks[-1] if ks else 2)
    model = min(_fit_all(vectors, [(best, SEED), (best, SEED + 1)]), key=lambda m: m.summary.trainingCost)
    labelled = model.transform(vectors).withColumnRenamed("prediction", "cluster")
    distinct = labelled.select("cluster").distinct().count()
    silhouette = (
        float(ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(labelled))
        if distinct > 1
        else 0.0
    )
    return {
        "elbow": spark.createDataFrame(list(zip(ks, inertias)), "k int, inertia double"),
        "assignments": labelled.select(*[quoted(c) for c in (keep or [])], "cluster"),
        "sizes": cluster_sizes(labelled),
        "metrics": spark.createDataFrame([(int(best), silhouette)], "k int, silhouette double"),
        "projection": projection(labelled, ["cluster", *(keep or [])]),
        "centroids": centroids(labelled, columns),
    }


def projection(vectors: DataFrame, keep: list[str]) -> DataFrame:
    """Two principal components of the rows; each component's largest loading is positive."""
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] > 0 else -1.0 for j in range(2)]
    scores = model.transform(vectors).withColumn("pc", vector_to_array("pc"))
    return scores.select(
        *[quoted(c) for c in keep], (F.col("pc")[0] * signs[0]).alias("pc1"), (F.col("pc")[1] * signs[1]).alias("pc2")
    )


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """(cluster, size, share): a row per cluster."""
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("n"))
    return sizes.withColumn("share", F.col("size") / total.scalar())


def centroids(labelled: DataFrame, columns: list[str], xs: str = "xs") -> DataFrame:
    """(cluster, column, mean, variance) of the array column ``xs``, population variance."""
    aggregates = []
    for i, c in enumerate(columns):
        v = F.col(xs)[i]
        aggregates.append(
            F.struct(F.lit(c).alias("column"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance")).alias(f"c{i}")
        )
    wide = labelled.groupBy("cluster").agg(*aggregates)
    return wide.select("cluster", F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))


def ward_labels(centres: np.ndarray, weights: np.ndarray, clusters: int) -> np.ndarray:
    """Ward merging of weighted centres down to ``clusters`` groups; labels 1.. by first member."""
    centres, weights = centres.astype(float).copy(), weights.astype(float).copy()
    groups = [[i] for i in range(len(centres))]
    alive = np.ones(len(centres), dtype=bool)

    def costs(i: int) -> np.ndarray:
        c = weights[i] * weights / (weights[i] + weights) * ((centres - centres[i]) ** 2).sum(axis=1)
        c[~alive] = np.inf
        c[i] = np.inf
        return c

    table = np.array([costs(i) for i in range(len(centres))])
    while alive.sum() > clusters:
        i, j = np.unravel_index(np.argmin(table), table.shape)
        total = weights[i] + weights[j]
        centres[i] = (weights[i] * centres[i] + weights[j] * centres[j]) / total
        weights[i] = total
        groups[i] += groups[j]
        alive[j] = False
        table[j, :] = np.inf
        table[:, j] = np.inf
        row = costs(i)
        table[i, :] = row
        table[:, i] = row
        table[i, i] = np.inf
    labels = np.zeros(len(centres), dtype=int)
    for label, i in enumerate(sorted(np.flatnonzero(alive), key=lambda i: min(groups[i])), 1):
        labels[groups[i]] = label
    return labels


def hierarchical(
    df: DataFrame, columns: list[str], keep: list[str] | None = None, micro: int = MICRO_CLUSTERS, clusters: int = WARD_CLUSTERS
) -> dict[str, DataFrame]:
    """Ward clustering of all rows: Spark K-means to ``micro`` weighted centres, Ward on those, rows follow."""
    vectors = _vectors(standardised(df, columns, keep)).persist()
    n = vectors.count()
    wanted = max(1, min(clusters, n - 1))
    model = KMeans(k=max(2, min(micro, n)), seed=SEED, featuresCol="features", maxIter=10).fit(vectors)
    labelled = model.transform(vectors)
    sizes = {r["prediction"]: r["n"] for r in labelled.groupBy("prediction").agg(F.count("*").alias("n")).collect()}
    used = sorted(sizes)
    centres = np.array([model.clusterCenters()[i] for i in used])
    labels = ward_labels(centres, np.array([sizes[i] for i in used], dtype=float), wanted)
    # At most ``micro`` entries.
    mapping = F.create_map(*[F.lit(x) for i, label in zip(used, labels) for x in (int(i), int(label))])
    final = labelled.withColumn("cluster", F.element_at(mapping, F.col("prediction")))
    return {
        "assignments": final.select(*[quoted(c) for c in (keep or [])], "cluster"),
        "sizes": cluster_sizes(final),
        "projection": projection(final, ["cluster", *(keep or [])]),
        "centroids": centroids(final, columns),
    }


def pca(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> dict[str, DataFrame]:
    """``variance`` (component, ratio, cumulative), ``loadings``, ``scores`` (pc1, pc2) on standardised rows."""
    if len(columns) < 3:
        raise ValueError("principal components need at least three numeric columns")
    spark = df.sparkSession
    vectors = _vectors(standardised(df, columns, keep)).persist()
    k = min(len(columns), 10)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(vectors)
    ratio = model.explainedVariance.toArray()
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] > 0 else -1.0 for j in range(k)]
    cumulative = np.cumsum(ratio)
    return {
        "variance": spark.createDataFrame(
            [(i + 1, float(ratio[i]), float(cumulative[i])) for i in range(k)],
            "component int, ratio double, cumulative double",
        ),
        "loadings": spark.createDataFrame(
            [(c, j + 1, float(loadings[i, j] * signs[j])) for i, c in enumerate(columns) for j in range(k)],
            "column string, component int, loading double",
        ),
        "scores": projection(vectors, keep or []),
    }
