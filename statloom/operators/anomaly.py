"""Outliers by z-score and by isolation forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from statloom.operators.describe import _binned
from statloom.roles import number, quoted
from statloom.session import spread

Z_LIMIT = 3.0
# Isolation forest settings (fixed values).
TREES = 100
TREE_ROWS = 256
SCORE_LIMIT = 0.5


def z_scores(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus ``z_<c>``: |z| with the population deviation, and ``max_z``.

    Means and deviations come from one aggregation: two numbers per column, used as literals.
    """
    facts = [f for c in columns for f in (F.avg(number(c)), F.stddev_pop(number(c)))]
    stats = df.agg(*facts).first()
    zs: list[Column] = []
    for i, c in enumerate(columns):
        mean, deviation = stats[2 * i], stats[2 * i + 1]
        z = F.abs(number(c) - mean) / deviation if deviation else F.lit(None).cast("double")
        zs.append(z.alias(f"z_{c}"))
    scored = df.select(*[quoted(k) for k in (keep or [])], *zs)
    names = [quoted(f"z_{c}") for c in columns]
    return scored.withColumn("max_z", F.greatest(*names) if len(names) > 1 else names[0])


def z_score_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, anomalies): rows with any hit as ``(any)``, then columns that have hits."""
    scored = z_scores(df, columns)
    hits = {c: F.count_if(quoted(f"z_{c}") > Z_LIMIT) for c in columns}
    one = scored.agg(
        F.struct(F.lit("(any)").alias("column"), F.count_if(F.col("max_z") > Z_LIMIT).alias("anomalies")).alias("h"),
        *[F.struct(F.lit(c).alias("column"), h.alias("anomalies")).alias(f"h{i}") for i, (c, h) in enumerate(hits.items())],
    )
    rows = one.select(F.inline(F.array("h", *[F.col(f"h{i}") for i in range(len(columns))])))
    return rows.where((F.col("column") == "(any)") | (F.col("anomalies") > 0))


def z_score_top(df: DataFrame, columns: list[str], key: str, k: int = 10) -> DataFrame:
    """The k rows with the largest |z| in any column."""
    scored = z_scores(df, columns, [key]).where("max_z is not null")
    return scored.orderBy(F.desc("max_z"), quoted(key)).limit(k).select(quoted(key), "max_z")


def score_histogram(scores: DataFrame, column: str, bins: int = 50) -> DataFrame:
    values = scores.select(F.col(column).alias("v")).where("v is not null")
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return _binned(values.withColumn("e", edges.select(F.struct("lo", "hi")).scalar()).select("v", "e.lo", "e.hi"), bins)


def _path_norm(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    value = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def _grow(values: np.ndarray, seed: int) -> list[tuple[int, int, float, float]]:
    """Nodes of one tree in heap order: (node, feature or -1, threshold, leaf depth)."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(2, len(values)))))
    nodes: list[tuple[int, int, float, float]] = []
    open_nodes = [(1, np.arange(len(values)), 0)]
    while open_nodes:
        node, rows, depth = open_nodes.pop()
        part = values[rows]
        spread = part.max(axis=0) > part.min(axis=0) if len(rows) else np.zeros(values.shape[1], bool)
        if depth >= limit or len(rows) <= 1 or not spread.any():
            nodes.append((node, -1, 0.0, depth + float(_path_norm(len(rows)))))
            continue
        feature = int(rng.choice(np.flatnonzero(spread)))
        cut = float(rng.uniform(part[:, feature].min(), part[:, feature].max()))
        nodes.append((node, feature, cut, 0.0))
        left = part[:, feature] <= cut
        open_nodes += [(2 * node, rows[left], depth + 1), (2 * node + 1, rows[~left], depth + 1)]
    return nodes


def isolation_trees(vectors: DataFrame, seed: int = 42, trees: int = TREES) -> DataFrame:
    """(tree, node, feature, threshold, depth) of a forest over a ``features`` array column.

    A random pool of at most trees × 256 rows is drawn with a distributed top-k and laid out in
    random order. Slot s of trees × 256 slots takes pool row s modulo the pool size and belongs to
    tree s div 256, so each tree sees up to 256 different rows and no group is larger than that.
    """
    slots = trees * TREE_ROWS
    # a hash of the row, so that a recomputed task draws the same pool
    drawn_by = F.xxhash64(F.lit(seed), *[quoted(c) for c in vectors.columns])
    pool = vectors.select("features", drawn_by.alias("_u")).orderBy("_u").limit(slots)
    # The pool is bounded by the forest's size, so one task may number it.
    placed = pool.select(
        "features",
        (F.row_number().over(Window.orderBy("_u")) - 1).alias("_place"),
        F.count("*").over(Window.partitionBy()).alias("_size"),
    )
    per_tree = F.least(F.col("_size"), F.lit(TREE_ROWS))
    laps = F.sequence(F.lit(0), F.floor((F.lit(trees) * per_tree - 1 - F.col("_place")) / F.col("_size")).cast("int"))
    drawn = (
        placed.withColumn("_lap", F.explode(laps))
        .withColumn("_slot", F.col("_place") + F.col("_lap") * F.col("_size"))
        .select("features", "_slot", F.floor(F.col("_slot") / per_tree).cast("int").alias("tree"))
    )

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_slot")
        tree = int(part["tree"].iloc[0])
        grown = _grow(np.array(part["features"].tolist(), dtype=float), seed * 1000 + tree)
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "depth"])
        out.insert(0, "tree", tree)
        out["rows"] = len(part)
        return out

    return drawn.groupBy("tree").applyInPandas(
        build, "tree int, node long, feature int, threshold double, depth double, rows int"
    )


def isolation_scores(df: DataFrame, columns: list[str], keep: list[str], seed: int = 42) -> DataFrame:
    """``keep`` columns, ``score`` (higher is more anomalous), ``decision`` = 0.5 − score, ``is_anomaly``.

    The forest is at most 100 × 511 nodes, so it travels in the task closure; rows are scored in
    Arrow batches where they lie, without a shuffle.
    """
    vectors = df.select(*[quoted(k) for k in keep], F.array(*[number(c) for c in columns]).alias("features")).where(
        F.expr("forall(features, x -> x is not null)")
    )
    table = isolation_trees(vectors.select("features"), seed).toPandas()
    if table.empty:
        raise ValueError("isolation forest needs at least one complete row")
    forest = []
    for _, t in table.groupby("tree"):
        size = int(t["node"].max()) + 1
        feature = np.full(size, -1, dtype=np.int32)
        threshold = np.zeros(size)
        depth = np.zeros(size)
        node = t["node"].to_numpy()
        feature[node], threshold[node], depth[node] = t["feature"], t["threshold"], t["depth"]
        forest.append((feature, threshold, depth))
    norm = float(_path_norm(int(table["rows"].max())))
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = np.array(part["features"].tolist(), dtype=float).reshape(len(part), -1)
            total = np.zeros(len(part))
            line = np.arange(len(part))
            for feature, threshold, depth in shared.value:
                at = np.ones(len(part), dtype=np.int64)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    right = x[line, np.maximum(f, 0)] > threshold[at]
                    at = np.where(inner, 2 * at + right, at)
                total += depth[at]
            mean = total / len(shared.value)
            part = part.drop(columns="features")
            part["score"] = np.power(2.0, -mean / norm) if norm > 0 else np.full(len(part), 0.5)
            yield part

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "features"])
    scored = spread(vectors).mapInPandas(score, f"{schema}, score double" if schema else "score double")
    return scored.withColumn("decision", SCORE_LIMIT - F.col("score")).withColumn(
        "is_anomaly", F.col("score") > SCORE_LIMIT
    )


def isolation_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("total_rows"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        (F.count_if("is_anomaly") * 100.0 / F.count("*")).alias("anomaly_pct"),
    )


def isolation_top(scores: DataFrame, key: str, k: int = 10) -> DataFrame:
    return scores.orderBy("decision", quoted(key)).limit(k).select(quoted(key), "decision", "score")
