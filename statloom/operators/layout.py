"""Two-dimensional neighbour layouts of all rows (no row limit).

Neighbours are searched along several random projections: rows are put in the order of a projection,
cut into value ranges, and compared with the next few rows of the same range. The number of
comparisons is rows × projections × window, whatever the density. Each epoch of the layout is two
equi-joins and one aggregation of forces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from statloom.functions.ordered import order_bounds, positions, range_bucket
from statloom.operators.cluster import projection, standardised
from statloom.session import bucket_count, cut_lineage, discard, spread

NEIGHBORS = 15
PERPLEXITY = 30
PROJECTIONS = 8
WINDOW = 12
EPOCHS = 12
NEGATIVES = 5
DESCENT_ROUNDS = 2
TOGETHER = 64
SEED = 42


def neighbor_graph(rows: DataFrame, d: int, k: int, seed: int = SEED, rounds: int | None = None) -> DataFrame:
    """(id, other, dist): about the k nearest rows of every (id, xs) row: projection candidates,
    then ``rounds`` of neighbour descent."""
    start = projection_graph(rows, d, k, seed)
    return neighbor_descent(rows, start, d, k, DESCENT_ROUNDS if rounds is None else rounds)


def possible(xs: np.ndarray, ys: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of both sides, all those within the limits among them.

    Squares by one matrix product are off by far less than the margin; what is not a number passes.
    """
    a, b = (xs * xs).sum(1)[:, None], (ys * ys).sum(1)[None, :]
    return np.nonzero(~(a + b - 2.0 * (xs @ ys.T) > (limits * limits)[:, None] + 1e-9 * (a + b)))


def distances(xs: np.ndarray, ys: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distances of the columns ``own`` of xs and ``other`` of ys, where each row is a dimension."""
    square = np.zeros(len(own))
    for x, y in zip(np.ascontiguousarray(xs), np.ascontiguousarray(ys)):  # sums are added in one order everywhere
        gap = x[own] - y[other]
        square += gap * gap
    return np.sqrt(square)


def measured(met: DataFrame, d: int) -> DataFrame:
    """(id, other, dist) of rows (asking: id, limit, xs; near: other, ys): every asking row with every
    other row of the list that is no farther than its limit (null: any distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asking, near = batch.column(0), batch.column(1)
            asked, listed = asking.flatten(), near.flatten()
            ids, others = (c.field(0).to_numpy(zero_copy_only=False) for c in (asked, listed))
            limits = pc.fill_null(asked.field(1), math.inf).to_numpy(zero_copy_only=False)
            xs, ys = (v.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for v in (asked.field(2), listed.field(1)))
            sides = [np.concatenate([[0], np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False))]) for c in (asking, near)]
            for a, a_end, b, b_end in zip(sides[0], sides[0][1:], sides[1], sides[1][1:]):
                own, other = possible(xs[a:a_end], ys[b:b_end], limits[a:a_end])
                differ = ids[a + own] != others[b + other]
                own, other = own[differ], other[differ]
                dist = distances(xs[a:a_end].T, ys[b:b_end].T, own, other)
                near_enough = dist <= limits[a + own]
                own, other, dist = own[near_enough], other[near_enough], dist[near_enough]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a + own], pa.int64()), pa.array(others[b + other], pa.int64()), pa.array(dist)],
                    names=["id", "other", "dist"],
                )

    return met.select("asking", "near").mapInArrow(run, "id long, other long, dist double")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest others of each id; a pair that stands several times (at one distance) counts once."""
    rank = Window.partitionBy("id").orderBy("dist", "other")
    ranked = pairs.withColumn("_k", F.dense_rank().over(rank)).where(F.col("_k") <= k)
    return ranked.dropDuplicates(["id", "other"]).select("id", "other", "dist")


def neighbor_descent(rows: DataFrame, graph: DataFrame, d: int, k: int, rounds: int) -> DataFrame:
    """Refine a k-neighbour graph: a neighbour of a neighbour is a candidate.

    Each round joins the graph with itself through the middle row, over forward edges and the
    ``k`` nearest reverse edges of each row, so a row meets at most (2k)² candidates however many
    rows point at it. A middle row gets the vectors of its at most 2k neighbours once, the rows that
    point at it meet that list ``TOGETHER`` at a time, and only candidates within a row's present
    k-th distance leave: what is shuffled grows with the edges, not with the candidates. Every row
    keeps its ``k`` nearest of old and new. A round's graph is written before the next.
    """
    graph = cut_lineage(graph)
    vectors = rows.select("id", "xs")
    for _ in range(rounds):
        back = Window.partitionBy("other").orderBy("dist", "id")
        reverse = graph.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= k).select(
            F.col("other").alias("id"), F.col("id").alias("other")
        )
        near = cut_lineage(graph.select("id", "other").unionByName(reverse).distinct())
        lists = (
            near.join(vectors.select(F.col("id").alias("other"), F.col("xs").alias("ys")), "other")
            .groupBy(F.col("id").alias("middle"))
            .agg(F.collect_list(F.struct("other", "ys")).alias("near"))
        )
        limits = graph.groupBy("id").agg(F.when(F.count("*") >= k, F.max("dist")).alias("limit"))
        of_middle = Window.partitionBy("middle").orderBy("id")
        asking = (
            near.withColumnRenamed("other", "middle")
            .join(vectors.join(limits, "id", "left"), "id")
            .withColumn("part", F.floor((F.row_number().over(of_middle) - 1) / TOGETHER))
            .groupBy("middle", "part")
            .agg(F.collect_list(F.struct("id", "limit", "xs")).alias("asking"))
        )
        found = measured(asking.join(lists, "middle"), d)
        before = graph
        graph = cut_lineage(nearest(graph.unionByName(found), k))
        discard(before)
        discard(near)
    return graph


def followers(placed: DataFrame, d: int) -> DataFrame:
    """(id, other, dist) of each row and the next ``WINDOW`` rows of its (t, _range), in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, d))]
        for batch in batches:
            old = len(held[0])
            fresh = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            fresh.append(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            t, of, ids, xs = (np.concatenate(both) for both in zip(held, fresh))
            for ahead in range(1, WINDOW + 1):
                own = np.arange(max(0, old - ahead), max(0, len(ids) - ahead))
                own = own[(t[own] == t[own + ahead]) & (of[own] == of[own + ahead])]
                columns = [pa.array(ids[own]), pa.array(ids[own + ahead]), pa.array(distances(xs.T, xs.T, own, own + ahead))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "other", "dist"])
            held = [v[-WINDOW:] for v in (t, of, ids, xs)]

    rows = placed.select(F.col("t").cast("long"), F.col("_range").cast("long"), F.col("id").cast("long"), "xs")
    return rows.mapInArrow(run, "id long, other long, dist double")


def projection_graph(rows: DataFrame, d: int, k: int, seed: int = SEED) -> DataFrame:
    """(id, other, dist): the k nearest among rows that follow each other along random projections."""
    rng = np.random.default_rng(seed)
    axes = rng.normal(size=(PROJECTIONS, d))
    packed = []
    for t, axis in enumerate(axes / np.linalg.norm(axes, axis=1, keepdims=True)):
        score: Column = F.lit(0.0)
        for i, a in enumerate(axis):
            score = score + F.col("xs")[i] * float(a)
        packed.append(F.struct(F.lit(t).alias("t"), score.alias("s")))
    scored = rows.select("id", "xs", F.inline(F.array(*packed)))
    buckets = bucket_count(rows.sparkSession) * 2
    order = [F.col("t").alias("_o0"), F.col("s").alias("_o1"), F.col("id").alias("_o2")]
    bounds = order_bounds(scored.select("t", "s", "id"), order, ["t", "s", "id"], buckets)
    placed = scored.withColumn("_bounds", bounds.scalar()).withColumn(
        "_range", range_bucket(F.col("_bounds"), F.struct(*order), buckets)
    )
    pairs = followers(placed.repartition("t", "_range").sortWithinPartitions("t", "_range", "s", "id"), d)
    both = pairs.select(F.inline(F.array(F.struct("id", "other", "dist"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), "dist"))))
    return nearest(both, k)


def _perplexity_weights(perplexity: float):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def weights(dists: pd.Series) -> pd.Series:
        out = []
        for row in dists:
            d2 = np.asarray(row, dtype=float) ** 2
            d2 = d2 - d2.min()
            goal = math.log(min(perplexity, max(1.0001, len(d2) / 1.5)))
            lo, hi, beta = 0.0, math.inf, 1.0 / max(d2.mean(), 1e-12)
            for _ in range(40):
                e = np.exp(-d2 * beta)
                p = e / e.sum()
                entropy = float(-(p * np.log(np.maximum(p, 1e-300))).sum())
                if abs(entropy - goal) < 1e-4:
                    break
                if entropy > goal:
                    lo, beta = beta, beta * 2 if hi == math.inf else (beta + hi) / 2
                else:
                    hi, beta = beta, (beta + lo) / 2
            out.append((p / p.max()).tolist())
        return pd.Series(out)

    return weights


def edge_weights(graph: DataFrame, weighting: str) -> DataFrame:
    """(u, v, w): symmetric weights of the graph; each row's neighbour list holds at most k entries."""
    lists = graph.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dist", "other"))).alias("near"))
    dists = F.transform("near", lambda e: e["dist"])
    if weighting == "perplexity":
        lists = lists.withColumn("ws", _perplexity_weights(PERPLEXITY)(dists))
    else:
        first = F.element_at(dists, 1)
        scale = F.aggregate(dists, F.lit(0.0), lambda acc, x: acc + x - first) / F.size(dists)
        lists = lists.withColumn("_f", first).withColumn("_s", F.greatest(scale, F.lit(1e-12)))
        lists = lists.withColumn("ws", F.transform(dists, lambda x: F.exp(-(x - F.col("_f")) / F.col("_s"))))
    directed = lists.select("id", F.inline(F.arrays_zip("near", "ws"))).select(
        F.col("id").alias("u"), F.col("near.other").alias("v"), F.col("ws").alias("w")
    )
    both = directed.select("u", "v", "w", F.lit(0.0).alias("b")).unionByName(
        directed.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0.0).alias("w"), F.col("w").alias("b"))
    )
    joined = both.groupBy("u", "v").agg(F.max("w").alias("a"), F.max("b").alias("b"))
    mixed = (F.col("a") + F.col("b")) / 2 if weighting == "perplexity" else F.col("a") + F.col("b") - F.col("a") * F.col("b")
    return joined.select("u", "v", mixed.alias("w"))


def neighbor_layout_2d(
    df: DataFrame, columns: list[str], key: str, weighting: str = "uniform", epochs: int = EPOCHS, k: int | None = None
) -> DataFrame:
    """(key, x, y): rows that are near in the columns come to lie near in the plane.

    ``perplexity`` is t-SNE (``tsne_layout``: Barnes–Hut repulsion over all rows); ``uniform`` pulls
    along fuzzy neighbour weights and pushes from sampled rows.
    """
    if weighting not in ("uniform", "perplexity"):
        raise ValueError("weighting is 'uniform' or 'perplexity'")
    if weighting == "perplexity":
        return tsne_layout(df, columns, key, k=k)
    d = len(columns)
    rows = standardised(df, columns, [key]).withColumnRenamed(key, "_key")
    numbered = positions(rows.select("_key", "xs"), ["_key"]).withColumn("id", F.col("_pos") - 1).drop("_pos")
    rows = cut_lineage(numbered)
    n = rows.count()
    if n < 3:
        raise ValueError("a layout needs at least three complete rows")
    k = min(k or NEIGHBORS, n - 1)
    edges = cut_lineage(edge_weights(neighbor_graph(rows.select("id", "xs"), d, k), weighting))
    start = projection(rows.withColumn("features", array_to_vector("xs")), ["id"])
    scale = start.agg(F.stddev_pop("pc1").alias("s")).first()["s"] or 1.0
    place = start.select("id", (F.col("pc1") / scale * 4).alias("x"), (F.col("pc2") / scale * 4).alias("y"))
    place = cut_lineage(place)
    degree = edges.groupBy("u").agg(F.sum("w").alias("deg"))
    pull = cut_lineage(edges.join(degree, "u").select("u", "v", (F.col("w") / F.col("deg")).alias("a")))
    everyone = rows.select("id")
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        picks = F.transform(
            F.sequence(F.lit(0), F.lit(NEGATIVES - 1)), lambda j: F.pmod(F.xxhash64("id", j, F.lit(epoch)), F.lit(n))
        )
        push = everyone.select(F.col("id").alias("u"), F.explode(picks).alias("v")).where("u <> v")
        links = pull.select("u", "v", "a").unionByName(push.select("u", "v", F.lit(-1.0).alias("a")))
        at = lambda s: place.select(F.col("id").alias(s), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
        met = links.join(at("u"), "u").join(at("v"), "v")
        dx, dy = F.col("xu") - F.col("xv"), F.col("yu") - F.col("yv")
        d2 = dx * dx + dy * dy
        attract = -2.0 / (1.0 + d2) * F.col("a") * 4
        repel = 2.0 / ((0.01 + d2) * (1.0 + d2)) / NEGATIVES
        force = F.when(F.col("a") > 0, attract).otherwise(repel)
        moves = met.groupBy("u").agg(F.sum(force * dx).alias("fx"), F.sum(force * dy).alias("fy"))
        clip = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c)) * rate
        place = place.join(moves, F.col("id") == F.col("u"), "left").select(
            "id",
            (F.col("x") + F.coalesce(clip(F.col("fx")), F.lit(0.0))).alias("x"),
            (F.col("y") + F.coalesce(clip(F.col("fy")), F.lit(0.0))).alias("y"),
        )
        place = cut_lineage(place)
    return rows.select("_key", "id").join(place, "id").select(F.col("_key").alias(key), "x", "y")


# --- t-SNE with Barnes–Hut repulsion over a quad-tree ---------------------------------------------

THETA = 0.5
POINTS_AT_ONCE = 1024
TSNE_EPOCHS = 40
EXAGGERATION, EXAGGERATED = 4.0, 10
CELL_BROADCAST = 2_000_000


def _cell_of(x: Column, y: Column, level: Column, origin: tuple[float, float], side: float) -> tuple[Column, Column]:
    scale = F.pow(F.lit(2.0), level) / side
    top = F.pow(F.lit(2.0), level) - 1
    cx = F.least(F.floor((x - origin[0]) * scale), top).cast("long")
    cy = F.least(F.floor((y - origin[1]) * scale), top).cast("long")
    return cx, cy


def quad_cells(place: DataFrame, depth: int, origin: tuple[float, float], side: float) -> DataFrame:
    """(l, cx, cy, m, gx, gy): every non-empty cell of levels 1..depth with its mass and centre."""
    levels = place.select("x", "y", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("l"))
    cx, cy = _cell_of(F.col("x"), F.col("y"), F.col("l"), origin, side)
    return (
        levels.select("l", cx.alias("cx"), cy.alias("cy"), "x", "y")
        .groupBy("l", "cx", "cy")
        .agg(F.count(F.lit(1)).alias("m"), F.avg("x").alias("gx"), F.avg("y").alias("gy"))
    )


def tree_depth(n: int) -> int:
    return max(2, math.ceil(math.log(max(n, 2), 4)) + 2)


class QuadTree:
    """The quad-tree over points in numpy: per level the non-empty cells in the order of their codes.

    A cell's code interleaves the bits of its column and row, so its children follow each other one
    level down. Same cells, masses and centres as ``quad_cells``.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int):
        self.depth = depth
        self.origin = (float(x.min()), float(y.min()))
        self.side = max(float(x.max()) - self.origin[0], float(y.max()) - self.origin[1], 1e-9) * (1 + 1e-9)
        codes = self.codes(x, y)
        order = np.argsort(codes, kind="stable")
        codes, x, y = codes[order], x[order], y[order]
        self.levels: list[tuple[np.ndarray, ...]] = []
        for level in range(1, depth + 1):
            own = codes >> 2 * (depth - level)
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            mass = np.diff(np.r_[first, len(own)])
            centre = [np.add.reduceat(v, first) / mass for v in (x, y)]
            self.levels.append((own[first], mass.astype(np.float64), *centre))

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Codes of the points' cells of the deepest level."""
        scale, top = 2.0**self.depth / self.side, 2**self.depth - 1
        out = np.zeros(len(x), np.int64)
        for shift, v, o in ((1, x, self.origin[0]), (0, y, self.origin[1])):
            cell = np.minimum(np.floor((v - o) * scale), top).astype(np.int64)
            for bit in range(self.depth):
                out |= (cell >> bit & 1) << 2 * bit + shift
        return out

    def pushes(self, x: np.ndarray, y: np.ndarray, theta: float) -> tuple[np.ndarray, ...]:
        """z, rx and ry of ``repulsion`` for some of the tree's points."""
        z, rx, ry = (np.zeros(len(x)) for _ in range(3))
        codes = self.codes(x, y)
        cell = np.tile(np.arange(len(self.levels[0][0])), len(x))
        row = np.repeat(np.arange(len(x)), len(self.levels[0][0]))
        for level, (code, mass, gx, gy) in enumerate(self.levels, 1):
            inside = codes[row] >> 2 * (self.depth - level) == code[cell]
            size = self.side / 2**level
            dx, dy = x[row] - gx[cell], y[row] - gy[cell]
            take = ~inside & (size * size < theta * theta * (dx * dx + dy * dy))
            if level == self.depth:
                take[:] = True
            own, at, within = row[take], cell[take], inside[take]
            m = mass[at] - within
            centre = [np.where(within, (g[at] * mass[at] - v[own]) / np.maximum(m, 1.0), g[at]) for g, v in ((gx, x), (gy, y))]
            ex, ey = x[own] - centre[0], y[own] - centre[1]
            q = 1.0 / (1.0 + ex * ex + ey * ey)
            for total, part in ((z, m * q), (rx, m * q * q * ex), (ry, m * q * q * ey)):
                total += np.bincount(own, part, len(x))
            if level < self.depth:
                row, cell, parents = row[~take], cell[~take], self.levels[level][0] >> 2
                first = np.searchsorted(parents, code[cell])
                many = np.searchsorted(parents, code[cell], "right") - first
                row = np.repeat(row, many)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(many) - many - first, many)
        return z, rx, ry


def near_points(place: DataFrame, n: int, depth: int) -> tuple[Broadcast, int] | None:
    """(id, x, y) of all rows as arrays for every task; None where rows or cells are more than ``CELL_BROADCAST``."""
    if not 0 < n <= CELL_BROADCAST:
        return None
    held = place.select("id", "x", "y").toArrow()
    points = tuple(held.column(c).to_numpy() for c in ("id", "x", "y"))
    cells = sum(min(4**level, n) for level in range(1, depth + 1))
    if cells > CELL_BROADCAST:  # at most so many; fewer where points lie close
        cells = sum(len(level[0]) for level in QuadTree(*points[1:], depth).levels)
    return (place.sparkSession.sparkContext.broadcast(points), depth) if cells <= CELL_BROADCAST else None


def near_repulsion(place: DataFrame, points: Broadcast, depth: int, theta: float) -> DataFrame:
    """``repulsion`` where every task holds the whole quad-tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            tree = tree or QuadTree(*points.value[1:], depth)
            for start in range(0, batch.num_rows, POINTS_AT_ONCE):
                part = batch.slice(start, POINTS_AT_ONCE)
                x, y = (part.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
                sums = [pa.array(v) for v in tree.pushes(x, y, theta)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *sums], names=["id", "z", "rx", "ry"])

    return spread(place.select("id", "x", "y")).mapInArrow(run, "id long, z double, rx double, ry double")


def near_attraction(edges: DataFrame, points: Broadcast) -> DataFrame:
    """(id, ax, ay): Σᵥ p q (yᵤ − yᵥ), summed within batches, where every task holds all points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs = None
        for batch in batches:
            if xs is None:
                ids, *values = points.value
                xs = [np.empty(len(ids)) for _ in values]
                for to, v in zip(xs, values):
                    to[ids] = v
            u, v, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "p"))
            dx, dy = (c[u] - c[v] for c in xs)
            own, at = np.unique(u, return_inverse=True)
            pq = p / (1.0 + dx * dx + dy * dy)
            sums = [pa.array(np.bincount(at, pq * gap, len(own))) for gap in (dx, dy)]
            yield pa.RecordBatch.from_arrays([pa.array(own), *sums], names=["id", "ax", "ay"])

    return edges.select("u", "v", "p").mapInArrow(run, "id long, ax double, ay double")


def repulsion(place: DataFrame, theta: float = THETA, depth: int | None = None) -> DataFrame:
    """(id, z, rx, ry): Σⱼ q and Σⱼ q² (yᵢ − yⱼ) over all other rows, q = 1 / (1 + |yᵢ − yⱼ|²).

    Barnes–Hut by cell opening: every row starts at the four cells of level 1; a cell is taken whole
    when its side is below ``theta`` times its distance to the row's point and the point is not
    inside it, else its four children come next. Cells of the deepest level are always taken, the
    row's own cell without the row. Within ``CELL_BROADCAST`` points and cells each task holds the
    quad-tree and opens its rows' cells in numpy; beyond, see ``far_repulsion``.
    """
    n = place.count()
    depth = depth or tree_depth(n)
    held = near_points(place, n, depth)
    return near_repulsion(place, *held, theta) if held else far_repulsion(place, theta, depth)


def far_repulsion(place: DataFrame, theta: float, depth: int) -> DataFrame:
    """``repulsion`` with the quad-tree as a table of cells (level, column, row) with mass and centre.

    Each level is one join of open (row, cell) pairs with the cells; the cells table is broadcast
    within ``CELL_BROADCAST`` rows, else joined by a shuffle whose hot cells adaptive execution splits.
    """
    box = place.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    origin = (float(box[0]), float(box[2]))
    side = max(float(box[1]) - origin[0], float(box[3]) - origin[1], 1e-9) * (1 + 1e-9)
    cells = written = cut_lineage(quad_cells(place, depth, origin, side))
    if cells.count() <= CELL_BROADCAST:
        cells = F.broadcast(cells)
    children = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    frontier = place.select("id", "x", "y", F.lit(1).alias("l"), F.inline(children)).select(
        "id", "x", "y", "l", F.col("i").cast("long").alias("cx"), F.col("j").cast("long").alias("cy")
    )
    parts, held = [], []
    for level in range(1, depth + 1):
        met = frontier.join(cells, ["l", "cx", "cy"])
        own_x, own_y = _cell_of(F.col("x"), F.col("y"), F.col("l"), origin, side)
        inside = (own_x == F.col("cx")) & (own_y == F.col("cy"))
        size = side / 2**level
        dx, dy = F.col("x") - F.col("gx"), F.col("y") - F.col("gy")
        far = ~inside & (F.lit(size * size) < F.lit(theta * theta) * (dx * dx + dy * dy))
        met = met.withColumn("take", far | F.lit(level == depth)).withColumn("inside", inside).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(met)
        taken = met.where("take")
        mass = F.when(F.col("inside"), F.col("m") - 1).otherwise(F.col("m")).cast("double")
        cx = F.when(F.col("inside"), (F.col("gx") * F.col("m") - F.col("x")) / F.greatest(mass, F.lit(1.0))).otherwise(F.col("gx"))
        cy = F.when(F.col("inside"), (F.col("gy") * F.col("m") - F.col("y")) / F.greatest(mass, F.lit(1.0))).otherwise(F.col("gy"))
        ex, ey = F.col("x") - cx, F.col("y") - cy
        q = 1.0 / (1.0 + ex * ex + ey * ey)
        parts.append(taken.select("id", (mass * q).alias("z"), (mass * q * q * ex).alias("rx"), (mass * q * q * ey).alias("ry")))
        if level < depth:
            frontier = met.where("not take").select(
                "id", "x", "y", (F.col("l") + 1).alias("l"), F.inline(children), F.col("cx").alias("px"), F.col("cy").alias("py")
            ).select("id", "x", "y", "l", (F.col("px") * 2 + F.col("i")).alias("cx"), (F.col("py") * 2 + F.col("j")).alias("cy"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    sums = every.groupBy("id").agg(F.sum("z").alias("z"), F.sum("rx").alias("rx"), F.sum("ry").alias("ry"))
    out = cut_lineage(place.select("id").join(sums, "id", "left").na.fill(0.0, ["z", "rx", "ry"]))
    for met in held:
        met.unpersist()
    discard(written)
    return out


def near_forces(place: DataFrame, edges: DataFrame, points: Broadcast, depth: int, theta: float) -> DataFrame:
    """``place`` with (z, rx, ry) of ``repulsion`` and the attraction (ax, ay): one shuffle of sums by row."""
    names = ["x", "y", "vx", "vy", "z", "rx", "ry", "ax", "ay"]
    parts = [place, near_repulsion(place, points, depth, theta), near_attraction(edges, points)]
    every = reduce(
        DataFrame.union, [p.select("id", *[F.col(c) if c in p.columns else F.lit(0.0).alias(c) for c in names]) for p in parts]
    )
    return cut_lineage(every.groupBy("id").agg(*[F.sum(c).alias(c) for c in names]))


def far_forces(place: DataFrame, edges: DataFrame, theta: float, depth: int) -> DataFrame:
    """Like ``near_forces``, by joins of edges and forces with the positions."""
    pushed = far_repulsion(place.select("id", "x", "y"), theta, depth)
    at = lambda s: place.select(F.col("id").alias(s), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    met = edges.join(at("u"), "u").join(at("v"), "v")
    dx, dy = F.col("xu") - F.col("xv"), F.col("yu") - F.col("yv")
    q = 1.0 / (1.0 + dx * dx + dy * dy)
    pulled = met.groupBy(F.col("u").alias("id")).agg(F.sum(F.col("p") * q * dx).alias("ax"), F.sum(F.col("p") * q * dy).alias("ay"))
    out = cut_lineage(place.join(pushed, "id").join(pulled, "id", "left").na.fill(0.0, ["ax", "ay"]))
    discard(pushed)
    return out


def affinities(rows: DataFrame, d: int, k: int, n: int, perplexity: float = PERPLEXITY) -> DataFrame:
    """(u, v, p): symmetric t-SNE affinities (p_j|i + p_i|j) / 2n over the neighbour graph."""
    graph = neighbor_graph(rows, d, k)
    lists = graph.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dist", "other"))).alias("near"))
    ws = _perplexity_weights(perplexity)(F.transform("near", lambda e: e["dist"]))
    lists = lists.withColumn("ws", ws).withColumn("_t", F.aggregate("ws", F.lit(0.0), lambda a, x: a + x))
    directed = lists.select("id", "_t", F.inline(F.arrays_zip("near", "ws"))).select(
        F.col("id").alias("u"), F.col("near.other").alias("v"), (F.col("ws") / F.col("_t")).alias("p")
    )
    both = directed.unionByName(directed.select(F.col("v").alias("u"), F.col("u").alias("v"), "p"))
    return both.groupBy("u", "v").agg((F.sum("p") / (2.0 * n)).alias("p"))


def tsne_layout(
    df: DataFrame, columns: list[str], key: str, epochs: int = TSNE_EPOCHS, theta: float = THETA, k: int | None = None
) -> DataFrame:
    """(key, x, y) by t-SNE: perplexity affinities over the neighbour graph pull, Barnes–Hut repulsion
    over all rows pushes; gradient steps with momentum and early exaggeration from the PCA start.

    Where every task can hold the points, an epoch is one shuffle of the forces' sums by row; else one
    join of the affinity edges with the positions, the quad-tree levels of ``far_repulsion`` and one
    join of forces with the positions. Sums or positions are written each epoch.
    """
    d = len(columns)
    rows = standardised(df, columns, [key]).withColumnRenamed(key, "_key")
    numbered = positions(rows.select("_key", "xs"), ["_key"]).withColumn("id", F.col("_pos") - 1).drop("_pos")
    rows = cut_lineage(numbered)
    n = rows.count()
    if n < 3:
        raise ValueError("a layout needs at least three complete rows")
    k = min(k or 3 * PERPLEXITY, n - 1)
    edges = affinities(rows.select("id", "xs"), d, k, n, min(PERPLEXITY, (n - 1) / 3))
    edges = cut_lineage(edges.repartitionByRange(bucket_count(df.sparkSession), "u", "v").sortWithinPartitions("u"))
    start = projection(rows.withColumn("features", array_to_vector("xs")), ["id"])
    scale = start.agg(F.stddev_pop("pc1").alias("s")).first()["s"] or 1.0
    place = cut_lineage(
        start.select("id", (F.col("pc1") / scale * 1e-2).alias("x"), (F.col("pc2") / scale * 1e-2).alias("y"),
                     F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    )
    rate = max(n / EXAGGERATION, 50.0)
    for epoch in range(epochs):
        boost = EXAGGERATION if epoch < EXAGGERATED else 1.0
        momentum = 0.5 if epoch < EXAGGERATED else 0.8
        held = near_points(place, n, tree_depth(n))
        forces = near_forces(place, edges, *held, theta) if held else far_forces(place, edges, theta, tree_depth(n))
        z = forces.agg(F.sum("z")).first()[0] or 1.0
        moved = forces.select(
            "id",
            (momentum * F.col("vx") - rate * 4.0 * (boost * F.col("ax") - F.col("rx") / z)).alias("vx"),
            (momentum * F.col("vy") - rate * 4.0 * (boost * F.col("ay") - F.col("ry") / z)).alias("vy"),
            "x", "y",
        )
        place, before = moved.select("id", (F.col("x") + F.col("vx")).alias("x"), (F.col("y") + F.col("vy")).alias("y"), "vx", "vy"), place
        discard(before)
        if held:
            held[0].destroy()
    return rows.select("_key", "id").join(place, "id").select(F.col("_key").alias(key), "x", "y")
