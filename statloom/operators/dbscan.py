"""DBSCAN over any number of rows, exact, without comparing all pairs.

Copies of a point are folded to one weighted point. Points are put into small cells whose points are
all within eps of each other; a cell that holds enough weight is *dense*: its points are core points
of one cluster without a single comparison. Only points of sparse cells (fewer than ``min_samples``
different points each) are compared, with cells in reach; a cell wholly inside eps counts in bulk.
Two dense cells are linked by comparing bounding boxes that are halved until decided. So the number of
comparisons grows with the rows and not with the square of the densest region. Clusters are the
connected components of linked cells and core points.

With many columns cells hold few points and the work tends to that of a neighbour join on the three
leading columns.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from statloom.functions.ordered import positions, weighted_quantiles
from statloom.operators.cluster import cluster_sizes, standardised
from statloom.session import cut_lineage

MIN_SAMPLES = 5
EPS_SHARE = 0.9
GRID_COLUMNS = 3
PROBE_ROWS = 1000
FAR = 1e300


def _square(a: str, b: str, d: int) -> Column:
    total = F.lit(0.0)
    for i in range(d):
        gap = F.col(a)[i] - F.col(b)[i]
        total = total + gap * gap
    return total


def _box_gap(lo_a: str, hi_a: str, lo_b: str, hi_b: str, d: int) -> Column:
    """Squared least distance of two boxes."""
    total = F.lit(0.0)
    for i in range(d):
        gap = F.greatest(F.col(lo_a)[i] - F.col(hi_b)[i], F.col(lo_b)[i] - F.col(hi_a)[i], F.lit(0.0))
        total = total + gap * gap
    return total


def _box_reach(lo_a: str, hi_a: str, lo_b: str, hi_b: str, d: int) -> Column:
    """Squared largest distance of two boxes."""
    total = F.lit(0.0)
    for i in range(d):
        reach = F.greatest(F.col(hi_a)[i] - F.col(lo_b)[i], F.col(hi_b)[i] - F.col(lo_a)[i])
        total = total + reach * reach
    return total


def _cell(xs: str, width: float, dims: int) -> Column:
    return F.array(*[F.floor(F.col(xs)[i] / F.lit(width)) for i in range(dims)])


def _around(cell: str, dims: int) -> Column:
    """The cell and its neighbours."""
    offsets = itertools.product((-1, 0, 1), repeat=dims)
    return F.explode(F.array(*[F.array(*[F.col(cell)[i] + o for i, o in enumerate(off)]) for off in offsets]))


def distinct_points(rows: DataFrame) -> DataFrame:
    """(id, xs, w): a row per different point; the id is the smallest key of its rows."""
    return rows.groupBy("xs").agg(F.min("key").alias("id"), F.count("*").alias("w")).select("id", "xs", "w")


def neighbor_distances(points: DataFrame, d: int, k: int, share: float = 1.0) -> DataFrame:
    """(id, w, kd): distance to the k-th nearest row, the row itself counted as the first.

    The search radius doubles from a probe's estimate; only points still short of k rows look on, so
    a point is a candidate for few others in every round. Once a ``share`` of the rows is known the
    rest is left at a value beyond all others.
    """
    dims = min(d, GRID_COLUMNS)
    totals = points.agg(F.count("*").alias("n"), F.sum("w").alias("w")).first()
    n, rows = totals["n"], totals["w"]
    need = math.ceil(share * (rows - 1)) + 1
    probe = points.orderBy(F.xxhash64("id")).limit(PROBE_ROWS).select("xs").collect()
    x = np.array([r["xs"] for r in probe], dtype=float)
    gaps = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    gaps.sort(axis=1)
    near = gaps[:, min(k - 1, len(x) - 1)]
    near = near[near > 0]
    level = 0.5 if n <= PROBE_ROWS else 0.05
    radius = float(np.quantile(near, level)) * (len(x) / n) ** (1.0 / d) if len(near) else 1.0
    known = points.where(F.col("w") >= k).select("id", "w", F.lit(0.0).alias("kd"))
    open_points = cut_lineage(points.where(F.col("w") < k))
    done = rows - (open_points.agg(F.sum("w")).first()[0] or 0)
    while done < need:
        data = points.select(
            F.col("id").alias("o"), F.col("xs").alias("ys"), F.col("w").alias("ow"), _cell("xs", radius, dims).alias("cell")
        )
        asked = open_points.withColumn("_c", _cell("xs", radius, dims)).withColumn("cell", _around("_c", dims)).drop("_c")
        near_rows = (
            asked.join(data, "cell")
            .withColumn("dist", F.sqrt(_square("xs", "ys", d)))
            .where(F.col("dist") <= radius)
            .select("id", "w", "o", "ow", "dist")
        )
        rank = Window.partitionBy("id").orderBy("dist", "o")
        # k different points weigh at least k rows; the limit is applied before the shuffle.
        nearest = near_rows.withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= k)
        upto = Window.partitionBy("id").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
        reached = (
            nearest.withColumn("_sum", F.sum("ow").over(upto))
            .where(F.col("_sum") >= k)
            .groupBy("id")
            .agg(F.first("w").alias("w"), F.min("dist").alias("kd"))
        )
        found = cut_lineage(reached)
        known = known.unionByName(found)
        done += found.agg(F.sum("w")).first()[0] or 0
        open_points = cut_lineage(open_points.join(found.select("id"), "id", "left_anti"))
        radius *= 2
    return known.unionByName(open_points.select("id", "w", F.lit(FAR).alias("kd")))


def choose_eps(points: DataFrame, d: int) -> float:
    """90th percentile of the distance to the 5th row, the row itself included."""
    rows = points.agg(F.sum("w")).first()[0]
    k = max(1, min(MIN_SAMPLES, rows - 1))
    kd = neighbor_distances(points, d, k, EPS_SHARE)
    table = kd.groupBy("kd").agg(F.sum("w").alias("n"))
    return float(weighted_quantiles(table, "kd", {"eps": EPS_SHARE}).first()["eps"])


def _split_until_linked(points: DataFrame, pairs: DataFrame, side: float, eps: float, d: int) -> DataFrame:
    """(a, b) of the dense cell pairs that hold two points within eps.

    Boxes of both cells are halved; a pair of boxes is settled by the distance of two real points, by
    the boxes lying wholly inside eps, or by lying apart. Single points end every branch.
    """
    open_pairs = cut_lineage(
        pairs.select("a", "b", _cell("lo_a", side, d).alias("ka"), _cell("lo_b", side, d).alias("kb"))
    )
    linked: DataFrame | None = None
    width = side
    while open_pairs.limit(1).count():
        width /= 2
        units = open_pairs.select(F.col("a").alias("unit")).unionByName(open_pairs.select(F.col("b").alias("unit"))).distinct()
        inner = points.join(units, "unit").withColumn("k", _cell("xs", width, d))
        nodes = inner.groupBy("unit", "k").agg(
            F.array(*[F.min(F.col("xs")[i]) for i in range(d)]).alias("lo"),
            F.array(*[F.max(F.col("xs")[i]) for i in range(d)]).alias("hi"),
            F.min("xs").alias("rep"),
        )
        nodes = nodes.withColumn("up", F.transform("k", lambda v: F.floor(v / 2)))

        def side_of(s: str) -> DataFrame:
            return nodes.select(
                F.col("unit").alias(s), F.col("up").alias(f"k{s}"), F.col("k").alias(f"c{s}"),
                *[F.col(c).alias(f"{c}_{s}") for c in ("lo", "hi", "rep")],
            )

        tried = open_pairs.join(side_of("a"), ["a", "ka"]).join(side_of("b"), ["b", "kb"])
        box = ("lo_a", "hi_a", "lo_b", "hi_b", d)
        hit = (_square("rep_a", "rep_b", d) <= eps * eps) | (_box_reach(*box) <= eps * eps)
        judged = cut_lineage(
            tried.where(_box_gap(*box) <= eps * eps).select("a", "b", F.col("ca").alias("ka"), F.col("cb").alias("kb"), hit.alias("hit"))
        )
        found = judged.where("hit").select("a", "b").distinct()
        linked = found if linked is None else linked.unionByName(found)
        open_pairs = cut_lineage(judged.select("a", "b", "ka", "kb").join(found, ["a", "b"], "left_anti"))
    return linked if linked is not None else pairs.select("a", "b").limit(0)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component = smallest node) by alternating large-star and small-star joins.

    Every step is an aggregation of minima and an equi-join; no neighbour list is collected.
    """
    pairs = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        pairs = cut_lineage(moved.where("u <> v").distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    labels = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(labels, F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def point_labels(points: DataFrame, d: int, eps: float, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(id, component, is_core): component null for noise."""
    dims = min(d, GRID_COLUMNS)
    side = eps / (2 * math.sqrt(d))
    celled = cut_lineage(points.withColumn("cell", _cell("xs", side, d)))
    cells = cut_lineage(
        celled.groupBy("cell").agg(
            F.min("id").alias("cid"),
            F.sum("w").alias("cw"),
            F.array(*[F.min(F.col("xs")[i]) for i in range(d)]).alias("lo"),
            F.array(*[F.max(F.col("xs")[i]) for i in range(d)]).alias("hi"),
        ).withColumn("dense", F.col("cw") >= min_samples)
    )
    members = cut_lineage(celled.join(cells.select("cell", "cid", "dense"), "cell").select("id", "xs", "w", "cid", "dense"))
    # Boxes within eps have lower corners less than eps + side apart in every column.
    reach = eps + side
    facts = ("cid", "lo", "hi", "cw", "dense")
    left = cells.select(*[F.col(c).alias(f"{c}_a") for c in facts], _cell("lo", reach, dims).alias("_g"))
    left = left.withColumn("g", _around("_g", dims)).drop("_g")
    right = cells.select(*[F.col(c).alias(f"{c}_b") for c in facts], _cell("lo", reach, dims).alias("g"))
    pairs = cut_lineage(
        left.join(right, "g").where(_box_gap("lo_a", "hi_a", "lo_b", "hi_b", d) <= eps * eps).drop("g")
    )
    sparse = members.where("not dense").select("id", "xs", "w", "cid")
    seen = sparse.join(
        pairs.select("cid_a", "cid_b", "lo_b", "hi_b", "cw_b", "dense_b"), F.col("cid") == F.col("cid_a")
    ).where(_box_gap("xs", "xs", "lo_b", "hi_b", d) <= eps * eps)
    seen = cut_lineage(
        seen.select("id", "xs", "w", "cid_b", "cw_b", "dense_b", (_box_reach("xs", "xs", "lo_b", "hi_b", d) <= eps * eps).alias("inside"))
    )
    others = members.select(F.col("cid").alias("cid_b"), F.col("id").alias("o"), F.col("xs").alias("ys"), F.col("w").alias("ow"))
    close = cut_lineage(
        seen.where("not inside").join(others, "cid_b").where(_square("xs", "ys", d) <= eps * eps)
        .select("id", "cid_b", "o", "ow", "dense_b")
    )
    weights = seen.where("inside").select("id", F.col("cw_b").alias("n")).unionByName(close.select("id", F.col("ow").alias("n")))
    core_sparse = weights.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("id")
    core_sparse = cut_lineage(core_sparse)
    # Units that can be linked: a dense cell, or a core point of a sparse cell.
    units = cells.where("dense").select(F.col("cid").alias("node")).unionByName(core_sparse.select(F.col("id").alias("node")))
    owner = members.join(core_sparse.select(F.col("id").alias("_c")), F.col("id") == F.col("_c"), "left")
    owner = owner.where("dense or _c is not null").select(
        F.col("id").alias("o"), F.when(F.col("dense"), F.col("cid")).otherwise(F.col("id")).alias("unit"), F.col("cid").alias("cid_b")
    )
    owner = cut_lineage(owner)
    # (id, unit): a sparse point and a unit with a core point within eps.
    near_units = cut_lineage(
        close.join(owner.select("o", "unit"), "o")
        .select("id", "unit")
        .unionByName(seen.where("inside").join(owner.select("cid_b", "unit"), "cid_b").select("id", "unit"))
        .distinct()
    )
    point_edges = near_units.join(core_sparse, "id").select(F.col("id").alias("a"), F.col("unit").alias("b"))
    dense_pairs = pairs.where("dense_a and dense_b and cid_a < cid_b").select(
        F.col("cid_a").alias("a"), F.col("cid_b").alias("b"), "lo_a", "hi_a", "lo_b", "hi_b"
    )
    whole = _box_reach("lo_a", "hi_a", "lo_b", "hi_b", d) <= eps * eps
    dense_points = members.where("dense").select(F.col("cid").alias("unit"), "xs")
    split = _split_until_linked(dense_points, dense_pairs.where(~whole), side, eps, d)
    edges = point_edges.unionByName(dense_pairs.where(whole).select("a", "b")).unionByName(split)
    components = connected_components(units, edges)
    core = owner.join(components, F.col("unit") == F.col("node")).select(
        F.col("o").alias("id"), "component", F.lit(True).alias("is_core")
    )
    border = (
        near_units.join(core_sparse, "id", "left_anti")
        .join(components, F.col("unit") == F.col("node"))
        .groupBy("id")
        .agg(F.min("component").alias("component"))
        .withColumn("is_core", F.lit(False))
    )
    found = cut_lineage(core.unionByName(border))
    noise = members.join(found, "id", "left_anti").select(
        "id", F.lit(None).cast(found.schema["component"].dataType).alias("component"), F.lit(False).alias("is_core")
    )
    return found.unionByName(noise)


def dbscan(
    df: DataFrame, columns: list[str], key: str, eps: float | None = None, min_samples: int = MIN_SAMPLES
) -> dict[str, DataFrame]:
    """``assignments`` (key, cluster, is_core; −1 for noise), ``sizes`` and ``metrics`` (n_clusters, n_noise, eps)."""
    if len(columns) < 2:
        raise ValueError("DBSCAN needs at least two numeric columns")
    d = len(columns)
    rows = standardised(df, columns, [key]).withColumnRenamed(key, "key")
    rows = cut_lineage(rows.withColumn("xs", F.transform("xs", lambda x: x + F.lit(0.0))))
    if rows.limit(3).count() < 3:
        raise ValueError("DBSCAN needs at least three complete rows")
    points = cut_lineage(distinct_points(rows))
    chosen = eps if eps is not None else choose_eps(points, d)
    if chosen > 0:
        labels = point_labels(points, d, chosen, min_samples)
    else:  # only copies are neighbours
        core = F.col("w") >= min_samples
        labels = points.select("id", F.when(core, F.col("id")).alias("component"), core.alias("is_core"))
    numbers = positions(labels.where("component is not null").select("component").distinct(), ["component"])
    numbered = cut_lineage(
        labels.join(numbers, "component", "left").select(
            "id", F.coalesce(F.col("_pos") - 1, F.lit(-1)).alias("cluster"), "is_core"
        )
    )
    placed = rows.join(points.select("id", "xs"), "xs").select("key", "id").join(numbered, "id")
    assignments = placed.select(F.col("key").alias(key), "cluster", "is_core")
    metrics = assignments.agg(
        (F.coalesce(F.max("cluster"), F.lit(-1)) + 1).alias("n_clusters"),
        F.count_if(F.col("cluster") == -1).alias("n_noise"),
        F.count_if("is_core").alias("n_core"),
        F.lit(chosen).alias("eps"),
    )
    return {
        "assignments": assignments,
        "sizes": cluster_sizes(assignments.where("cluster >= 0").select("cluster")),
        "metrics": metrics,
    }
