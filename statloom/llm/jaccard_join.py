"""N-gram Jaccard join with filters under several global token orders.

A document's set holds its distinct word shingles, as 64-bit hashes. Two sets of Jaccard similarity t
or more share a token among the first n - ceil(t n) + 1 of either set, whatever global order the tokens
are sorted in, and the places of the first one they share bound how many more they can. Under each order
such prefixes also bound the whole overlap: the prefix tokens two sets share, plus all that lies behind
the longer prefix. Candidates come from the first order, must pass the
bounds of the other orders too, and only then are their whole sets compared. All orders put frequent
tokens last (a frequency estimate, the same for all documents), so a passage that many documents share
makes no candidates; within equal frequency the orders differ by hash.

Steps, with what they shuffle:

1. Each text is read to its set's hash, size and min-hashes. Equal sets are one class from here on.
2. Classes that agree in several min-hashes with the most typical class of a bucket are compared with
   that class: one pair a class and bucket, not all pairs. Links join them to groups. This finds the large
   groups of near copies early; what it misses is left to step 4, which is exact.
3. Prefix tokens of every text are sent to their token once. For each token, sets outside its largest group
   meet the one set of that group that has the token foremost: a pair a row at most. Links join groups, so
   that few near copies are left that would meet every set of a large group one by one.
4. Tokens of one group alone are dropped. In the rest, sets meet those fronts of other groups that
   positions and sizes allow.
5. Parities of hashed tokens, about a bit a token, bound how much the sets of a pair differ; the pairs
   left fetch their prefixes under the further orders.
6. The pairs that pass all bounds are compared in full; links join groups. Tables are deleted once read.

Pairs inside a group are never needed: what is asked for is which documents are linked, directly or
through others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from statloom.llm.text import byte_texts, small_batches
from statloom.operators.dbscan import connected_components
from statloom.session import cut_lineage, discard

MIN_HASHES = 8
ORDERS = 3
LEADER_ROUNDS = 1
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(tokens: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of each token for every seed."""
    with np.errstate(over="ignore"):
        z = tokens + np.uint64(seed) * MULTIPLIER
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; one for all its words if they are fewer than ``size``."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    size = min(size, len(words))
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(0x100000001B3) + mixed(hashes[k : len(words) - size + 1 + k], 1)
    return np.unique(mixed(rolled, size))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def prefix(tokens: np.ndarray, order: int, frequent: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set under an order: rare before frequent, then by hash."""
    weight = np.zeros(len(tokens), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        weight = np.where(frequent[at] == tokens, counts[at], 0)
    return tokens[np.lexsort((mixed(tokens, 101 + order), weight))[: prefix_length(len(tokens), percent)]]


def parities(tokens: np.ndarray) -> bytes:
    """Whether an odd number of tokens falls on each bit; as many bits as tokens at least, a power of two."""
    size = max(64, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else 64
    return np.packbits((np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """How many tokens two sets cannot share at least, both sides counted, by their parities.

    A longer row of bits folds to the shorter one's length, as positions are the tokens' low bits.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def signed(tokens: np.ndarray) -> pa.Array:
    return pa.array(tokens.view(np.int64), pa.int64())


def summaries(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(id, row, cls, n, hashes, bits) of each text; row is a hash of id and text, cls is the set's hash, hashes its least token under MIN_HASHES orders, bits its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            classes, sizes, hashes, bits = [], [], [], []
            for data in byte_texts(batch, text_column):
                tokens = shingle_set(data, shingle)
                classes.append(xxhash.xxh3_64_intdigest(tokens.tobytes()))
                sizes.append(len(tokens))
                bits.append(parities(tokens))
                hashes.append([int(mixed(tokens, k + 2).min().view(np.int64)) for k in range(MIN_HASHES)] if len(tokens) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    signed(np.array(classes, np.uint64)),
                    pa.array(sizes, pa.int64()),
                    pa.array(hashes, pa.list_(pa.int64())),
                    pa.array(bits, pa.binary()),
                ],
                names=["id", "row", "cls", "n", "hashes", "bits"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    row = F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    return docs.select(id_column, text_column, row.alias("row")).mapInArrow(run, f"id {kind}, row long, cls long, n long, hashes array<long>, bits binary")


def sampled_tokens(docs: DataFrame, text_column: str, shingle: int, rate: int) -> DataFrame:
    """(cls, token): the tokens of the texts whose hash falls in the sample; copies of a text fall together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for data in byte_texts(batch, text_column):
                tokens = shingle_set(data, shingle)
                cls = np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))
                yield pa.RecordBatch.from_arrays([signed(np.full(len(tokens), cls)), signed(tokens)], names=["cls", "token"])

    sample = docs.where(F.pmod(F.xxhash64(text_column), F.lit(rate)) == 0)
    return sample.select(text_column).mapInArrow(run, "cls long, token long")


def frequent_tokens(samples: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in at least ``least`` sampled classes, the ``most`` commonest of them: an order, not a filter."""
    rows = (
        samples.distinct().groupBy("token").count().where(F.col("count") >= least).orderBy(F.desc("count"), "token").limit(most)
    ).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    counts = np.array([r["count"] for r in rows], np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefix_tokens(docs: DataFrame, text_column: str, shingle: int, percent: int, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, cls, place) for every token in the prefix under the first order; place is size * 2^32 + position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            tokens, classes, places = [], [], []
            for data in byte_texts(batch, text_column):
                own = shingle_set(data, shingle)
                if len(own):
                    first = prefix(own, 0, frequent, counts, percent)
                    tokens.append(first)
                    classes.append(np.full(len(first), xxhash.xxh3_64_intdigest(own.tobytes()), np.uint64))
                    places.append(np.arange(len(first), dtype=np.int64) + (len(own) << 32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate(tokens)), signed(np.concatenate(classes)), pa.array(np.concatenate(places))],
                    names=["token", "cls", "place"],
                )

    return docs.select(text_column).mapInArrow(run, "token long, cls long, place long")


def whole_sets(
    docs: DataFrame, wanted: DataFrame, firsts: bool, id_column: str, text_column: str, shingle: int, percent: int,
    frequent: np.ndarray, counts: np.ndarray, broadcast_rows: int,
) -> DataFrame:
    """(cls, tokens) of the classes of the wanted ids: all tokens, or the first ones under each further order.

    A class comes twice where its id does, which repeats pairs and no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            classes, sets = [], []
            for data in byte_texts(batch, text_column):
                own = shingle_set(data, shingle)
                classes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                if firsts:
                    own = np.concatenate([np.sort(prefix(own, k, frequent, counts, percent)) for k in range(1, ORDERS)])
                sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [signed(np.array(classes, np.uint64)), pa.array(sets, pa.binary())], names=["cls", "tokens"]
            )

    ids = wanted.select(F.col("id").alias("__id"))
    if ids.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    own = docs.select(id_column, text_column).join(ids, F.col(f"`{id_column}`").eqNullSafe(F.col("__id")), "left_semi")
    return own.mapInArrow(run, "cls long, tokens binary")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, ta, tb) that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
                both = shared(a, b)
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def within_reach(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb, ta, tb) whose parities leave room for the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keep = []
            for na, nb, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                needed = -(-percent * (na + nb) // (100 + percent))
                keep.append(na + nb - least_difference(ta, tb) >= 2 * needed)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long, na long, nb long")


def passing(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb, ta, tb) whose prefixes share enough under every further order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keep = []
            for na, nb, fa, fb in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                pa_, pb = prefix_length(na, percent), prefix_length(nb, percent)
                needed = -(-percent * (na + nb) // (100 + percent)) - max(na - pa_, nb - pb)
                a, b = np.frombuffer(fa, np.uint64), np.frombuffer(fb, np.uint64)
                keep.append(
                    all(
                        shared(a[k * pa_ : (k + 1) * pa_], b[k * pb : (k + 1) * pb]) >= max(1, needed)
                        for k in range(ORDERS - 1)
                    )
                )
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with the tokens of both sides as ta and tb."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("cls").alias(side), F.col("tokens").alias(f"t{side}")), side)
    return pairs


def similar_size(na: Column, nb: Column, percent: int) -> Column:
    return (100 * na >= percent * nb) & (100 * nb >= percent * na)


def seed_pairs(classes: DataFrame, percent: int, agreeing: int = 2) -> DataFrame:
    """(a, b): a class and the most typical class of min-hash buckets that both fall into, ``agreeing`` at least.

    A class is typical when its buckets are large: of copies with various edits, the one with fewest.
    """
    placed = classes.where("n > 0").select("cls", "n", F.posexplode("hashes").alias("k", "value"))
    sizes = placed.groupBy("k", "value").agg(F.count("*").alias("count")).where("count > 1")
    shared_rows = cut_lineage(placed.join(sizes, ["k", "value"]))
    typical = shared_rows.groupBy("cls").agg(F.sum("count").alias("typical"))
    ranked = shared_rows.join(typical, "cls")
    heads = ranked.groupBy("k", "value").agg(F.max(F.struct("typical", "cls", "n")).alias("head"))
    met = shared_rows.join(heads, ["k", "value"]).where("cls <> head.cls")
    return (
        met.where(similar_size(F.col("n"), F.col("head.n"), percent))
        .groupBy(F.col("head.cls").alias("a"), F.col("cls").alias("b"))
        .agg(F.count("*").alias("agree"))
        .where(F.col("agree") >= agreeing)
        .select("a", "b")
    )


def needed(n: Column, m: Column, percent: int) -> Column:
    """How many tokens sets of these sizes must share."""
    return F.ceil(percent * (n + m) / (100 + percent))


def size_and_position() -> tuple[Column, Column]:
    return F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))


def meeting_rows(postings: DataFrame, percent: int) -> DataFrame:
    """(token, cls, place, front) of the tokens that several classes have, one of them in its front.

    If the first token that two sets share is at place i of n and j of m, they share at most
    min(n - i, m - j) tokens. So of the smaller set only the first tokens, n - needed(n, n) of them,
    can be the first shared one ("front" rows); the larger set's whole prefix meets these alone.
    """
    size, position = size_and_position()
    placed = postings.select("token", "cls", "place", (size - position >= needed(size, size, percent)).alias("front"))
    by_token = Window.partitionBy("token")
    return (
        placed.select(
            "*",
            F.min("cls").over(by_token).alias("least"),
            F.max("cls").over(by_token).alias("greatest"),
            F.max("front").over(by_token).alias("fronts"),
        )
        .where("least <> greatest AND fronts")
        .select("token", "cls", "place", "front")
        .distinct()
    )


def grouped_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with the group of their class; a class that links with none so far is its own group."""
    return cut_lineage(rows.join(groups, "cls", "left").select("token", "cls", "place", "front", F.coalesce("group", "cls").alias("group")))


def open_rows(rows: DataFrame) -> DataFrame:
    """The rows of tokens in several groups, with n, at and whether they are in the token's largest group."""
    size, position = size_and_position()
    sizes = rows.groupBy("token", "group").count()
    main = sizes.groupBy("token").agg(
        F.max(F.struct("count", "group")).alias("largest"), F.count("*").alias("groups")
    ).where("groups > 1").select("token", F.col("largest.group").alias("main"))
    return rows.join(main, "token").select("*", size.alias("n"), position.alias("at"), (F.col("group") == F.col("main")).alias("in_main"))


def ordered_pairs(found: DataFrame) -> DataFrame:
    """(a, b, na, nb) of the pairs (x, y, nx, ny), each once."""
    first = F.col("x") < F.col("y")
    return cut_lineage(
        found.select(
            F.least("x", "y").alias("a"),
            F.greatest("x", "y").alias("b"),
            F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("na"),
            F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("nb"),
        ).distinct()
    )


def leader_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): a class and, for each of its tokens, the class of the token's largest group that has it foremost.

    That is a pair a row at most.
    """
    opened = open_rows(rows)
    leaders = opened.where("in_main").groupBy("token").agg(F.min(F.struct("at", "cls", "n")).alias("leader"))
    found = opened.where("not in_main").join(leaders, "token").where(similar_size(F.col("n"), F.col("leader.n"), percent))
    return ordered_pairs(found.select(F.col("leader.cls").alias("x"), F.col("cls").alias("y"), F.col("leader.n").alias("nx"), F.col("n").alias("ny")))


def candidate_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of classes in different groups that can be similar by size and first shared token.

    The rows are those of ``meeting_rows`` with their groups. Near copies that differ by too much to link
    meet behind their fronts only, and make no pairs however many they are.
    """
    opened = open_rows(rows)
    larger = opened.select("token", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ix"), F.col("group").alias("gx"), "in_main")
    smaller = opened.where("front").select(
        "token", F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("at").alias("iy"), F.col("group").alias("gy"), F.col("in_main").alias("y_main")
    )
    shares = needed(F.col("nx"), F.col("ny"), percent)
    fits = (
        (F.col("gx") != F.col("gy"))
        & (F.col("ny") <= F.col("nx"))
        & (100 * F.col("ny") >= percent * F.col("nx"))
        & (F.col("nx") - F.col("ix") >= shares)
        & (F.col("ny") - F.col("iy") >= shares)
    )
    # rows of a token's main group never meet each other
    found = larger.where("not in_main").join(smaller, "token").where(fits).select("x", "y", "nx", "ny").unionAll(
        larger.where("in_main").join(smaller.where("not y_main"), "token").where(fits).select("x", "y", "nx", "ny")
    )
    return ordered_pairs(found)


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 5,
    percent: int = 75,
    sample_rate: int = 64,
    frequent_from: int = 4,
    frequent_most: int = 500_000,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """(id, __row, n_shingles, cls, component_id), one row per input row.

    ``__row`` is a hash of id and text, by which texts can be joined again; ``cls`` is the hash of the set.
    Sets link at ``percent`` per cent Jaccard similarity or more; ``component_id`` is the smallest id
    reachable by links. Null and empty texts, and texts of white space, have no shingles and link with
    nothing: their component is their own id. Fewer words than ``shingle`` make one shingle of all. Equal
    sets are always linked, so repeated rows and ids are in one component; a null id is never the smallest
    unless it is alone. An empty table gives no rows; other columns are not looked at.

    ``sample_rate``, ``frequent_from`` and ``frequent_most`` only choose the token orders and cannot change
    the result; ``broadcast_rows`` bounds the ids that are broadcast, more are joined by a shuffle.
    """
    found = cut_lineage(summaries(docs, id_column, text_column, shingle))
    facts = [F.first(c).alias(c) for c in ("hashes", "bits")]
    classes = cut_lineage(found.where("n > 0").groupBy("cls", "n").agg(F.min("id").alias("id"), *facts))
    frequent, counts = frequent_tokens(sampled_tokens(docs, text_column, shingle, sample_rate), frequent_from, frequent_most)
    options = (id_column, text_column, shingle, percent, frequent, counts, broadcast_rows)

    seeds = cut_lineage(seed_pairs(classes, percent))

    def sets_of(pairs: DataFrame, firsts: bool) -> DataFrame:
        members = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        return cut_lineage(whole_sets(docs, classes.join(members, "cls", "left_semi"), firsts, *options))

    def kept(test: Callable[[DataFrame, int], DataFrame], pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that pass; they and the sets have been read then."""
        passed = cut_lineage(test(with_sets(pairs, sets), percent).distinct())
        discard(pairs)
        discard(sets)
        return passed

    def bits_of(pairs: DataFrame) -> DataFrame:
        members = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        return cut_lineage(classes.join(members, "cls", "left_semi").select("cls", F.col("bits").alias("tokens")))

    def groups_of(links: DataFrame) -> DataFrame:
        nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return connected_components(nodes, links).select(F.col("node").alias("cls"), F.col("component").alias("group"))

    early = kept(linked, seeds, sets_of(seeds, False))
    rows = grouped_rows(meeting_rows(prefix_tokens(docs, text_column, shingle, percent, frequent, counts), percent), groups_of(early))
    for _ in range(LEADER_ROUNDS):
        leads = leader_pairs(rows, percent)
        near = kept(within_reach, leads, bits_of(leads))
        met = kept(linked, near, sets_of(near, False))
        if not met.limit(1).count():
            break
        early, before = cut_lineage(early.unionAll(met).distinct()), rows
        rows = grouped_rows(before.drop("group"), groups_of(early))
        discard(before)

    pairs = candidate_pairs(rows, percent)
    discard(rows)
    close = kept(within_reach, pairs, bits_of(pairs))
    agreed = kept(passing, close, sets_of(close, True))
    late = kept(linked, agreed, sets_of(agreed, False))

    links = cut_lineage(early.unionAll(late).distinct())
    named = cut_lineage(classes.select("cls", "id").join(groups_of(links), "cls", "left").select("cls", "id", F.coalesce("group", "cls").alias("group")))
    least = named.groupBy("group").agg(F.min("id").alias("least"))
    component = named.join(least, "group").select("cls", "least")
    return found.join(component, "cls", "left").select(
        F.col("id").alias(id_column),
        F.col("row").alias("__row"),
        F.col("n").alias("n_shingles"),
        "cls",
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"),
    )
