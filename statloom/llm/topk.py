"""Exact top-k search by block-at-a-time pruning.

Every vector component is a term. Candidates are cut into blocks of neighbouring ids, each with a
forward index (its vectors) and, per term, the greatest and the smallest value in the block. A query
sums, term by term, the better of the two: no vector in the block scores higher. Blocks are scored in
the order of these sums through their forward indexes, until the next sum falls below the query's
k-th score.

Queries also go in blocks. A query block is sent to every shard of candidate blocks and meets one
block row at a time, so memory is bounded by one block of either side; the k-th scores found so far
stay with the task. What leaves a task is at most k rows a query. Scores are integers throughout.
Vectors travel in the narrowest integers that hold a block's values. The copies for the shards are
shuffled, never broadcast: Spark sizes them before they are copied and would take them for small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

BLOCK_SCHEMA = "part int, size int, dims int, ids binary, vectors binary"
HIT_SCHEMA = "query_id long, query_key long, vec_id long, score long"
LEAST = np.iinfo(np.int64).min + 1  # can be negated


def integer_vectors(column: pa.Array, scale: int) -> list[np.ndarray | None]:
    """floor(scale * x) of each component as a double; None for null vectors and those of odd components."""
    out: list[np.ndarray | None] = []
    for value in column.to_pylist():
        if value is None or any(x is None for x in value):
            out.append(None)
            continue
        row = np.floor(scale * np.array(value, np.float64))
        out.append(row.astype(np.int64) if np.isfinite(row).all() and (np.abs(row) < 2**62).all() else None)
    return out


def stack(rows: list[np.ndarray]) -> np.ndarray:
    """Rows as one matrix; shorter vectors end in zeros."""
    dims = max(map(len, rows), default=0)
    out = np.zeros((len(rows), dims), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def packed(matrix: np.ndarray) -> bytes:
    """The matrix in the narrowest integers of two, four or eight bytes that hold all its values."""
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return matrix.astype(kind).tobytes()


def make_blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """(part, size, dims, ids, vectors) rows of up to ``size`` vectors each, from (key, id, vector) rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        held: list[np.ndarray] = []
        number = 0

        def block() -> pa.RecordBatch:
            matrix = stack(held)
            values = [[number], [len(ids)], [matrix.shape[1]], [np.array(ids, np.int64).tobytes()], [packed(matrix)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)], names=["part", "size", "dims", "ids", "vectors"]
            )

        for batch in batches:
            for key, own, vector in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), integer_vectors(batch.column(2), scale)
            ):
                if vector is None:
                    continue
                ids += [key, own]
                held.append(vector)
                if len(held) == size:
                    yield block()
                    ids, held, number = [], [], number + 1
        if held:
            yield block()

    return rows.mapInArrow(pack, BLOCK_SCHEMA)


def unpack(size: int, dims: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs = np.frombuffer(ids, np.int64).reshape(-1, 2)
    kind = f"i{len(vectors) // (len(pairs) * dims)}" if dims else "i8"
    return pairs[:, 0], pairs[:, 1], np.frombuffer(vectors, kind).reshape(len(pairs), dims).astype(np.int64)


def inner_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    dims = min(queries.shape[1], vectors.shape[1])
    a, b = queries[:, :dims], vectors[:, :dims]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dims, 1)
    if bound < 2**53:  # doubles hold these sums exactly
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Search:
    """The k best so far of one query block, and the blocks' scoring in the order of their bounds."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int):
        self.keys, self.ids, self.queries, self.k = keys, ids, queries, k
        self.scores = np.full((len(ids), k), LEAST)
        self.found = np.zeros((len(ids), k), np.int64)
        self.scored = 0

    def visit(self, ids: np.ndarray, vectors: np.ndarray, block: int) -> None:
        """Take in candidates by blocks of ``block`` rows, most promising block first for each query."""
        cuts = range(0, len(ids), block)
        high = np.stack([vectors[c : c + block].max(0) for c in cuts])
        low = np.stack([vectors[c : c + block].min(0) for c in cuts])
        positive, negative = np.maximum(self.queries, 0), np.minimum(self.queries, 0)
        bounds = inner_products(positive, high) + inner_products(negative, low)
        order = np.argsort(-bounds, axis=1, kind="stable")
        for turn in range(order.shape[1]):
            chosen = order[:, turn]
            alive = np.flatnonzero(bounds[np.arange(len(chosen)), chosen] >= self.scores[:, -1])
            if not len(alive):
                break  # bounds only fall from here
            for number in np.unique(chosen[alive]):
                own = alive[chosen[alive] == number]
                at = number * block
                self._score(own, ids[at : at + block], vectors[at : at + block])

    def _score(self, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = inner_products(self.queries[own], vectors)
        scores[self.ids[own][:, None] == ids[None, :]] = LEAST
        self.scored += scores.size
        better = np.flatnonzero((scores >= self.scores[own, -1][:, None]).any(1))
        own, scores = own[better], scores[better]
        all_scores = np.concatenate([self.scores[own], scores], axis=1)
        all_ids = np.concatenate([self.found[own], np.broadcast_to(ids, scores.shape)], axis=1)
        best = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[own] = np.take_along_axis(all_scores, best, 1)
        self.found[own] = np.take_along_axis(all_ids, best, 1)

    def hits(self) -> pa.RecordBatch:
        row, place = np.nonzero(self.scores != LEAST)
        columns = [self.ids[row], self.keys[row], self.found[row, place], self.scores[row, place]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_key", "vec_id", "score"]
        )


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 10,
    scale: int = 1024,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block: int = 128,
    blocks_per_row: int = 8,
    queries_per_row: int = 512,
    searches_at_once: int = 64,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest inner products, ties to the smaller id.

    Candidates of the query's own id are left out. Rows whose id or vector is null, or whose vector
    holds a null or non-finite component, take no part on either side; a shorter vector counts as
    ending in zeros. Query rows of equal id and vector are one query; repeated candidates each count.
    A query without any candidate has no row. Other columns are not looked at.
    """
    spark = queries.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    vector = F.col(f"`{vector_column}`").cast(T.ArrayType(T.DoubleType()))

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).select(
            F.xxhash64(F.col(id_column), vector).alias("key"), F.col(id_column).cast("long").alias("id"), vector.alias("vector")
        )

    asked = keyed(queries).dropDuplicates(["key", "id"]).repartitionByRange("id").sortWithinPartitions("id", "key")
    held = keyed(candidates).repartitionByRange(shards, "id", "key").sortWithinPartitions("id")
    query_rows = make_blocks(asked, queries_per_row, scale).select(
        F.xxhash64("ids").alias("q_block"),
        F.struct("size", "dims", "ids", "vectors").alias("q"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    candidate_rows = make_blocks(held, block * blocks_per_row, scale).select(
        F.pmod(F.xxhash64("ids", "part"), F.lit(shards)).cast("int").alias("shard"),
        F.struct("size", "dims", "ids", "vectors").alias("c"),
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: dict[int, Search] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                name, q, c = (batch.column(i)[row].as_py() for i in range(3))
                if name not in running:
                    if len(running) == searches_at_once:
                        yield running.pop(next(iter(running))).hits()
                    running[name] = Search(*unpack(**q), k)
                _, ids, vectors = unpack(**c)
                running[name].visit(ids, vectors, block)
        for one in running.values():
            yield one.hits()

    met = candidate_rows.join(query_rows.hint("merge"), "shard").select("q_block", "q", "c")
    hits = met.mapInArrow(search, HIT_SCHEMA)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.c, d.c)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
