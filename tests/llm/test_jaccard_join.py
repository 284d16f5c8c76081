import random

import numpy as np

from statloom.llm import jaccard_join
from statloom.llm.jaccard_join import near_duplicates, prefix, prefix_length, shared, shingle_set


def brute(rows):
    """Smallest id reachable by links, over all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both * 100 >= 75 * (len(a) + len(sets[j]) - both):
                group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string").repartition(3)
    return sorted((tuple(r) for r in near_duplicates(docs, **options).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def planted(seed=5):
    """Texts, chains of near copies, a shared passage, one large group of near copies, and odd rows."""
    chance = random.Random(seed)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(chance.randint(1, 7)))
    passage = [word() for _ in range(30)]
    rows, doc = [], 0
    for _ in range(25):
        own = [word() for _ in range(chance.randint(8, 120))]
        if chance.random() < 0.5:
            own += passage
        for _ in range(chance.choice([1, 1, 2, 5])):
            rows.append((doc, " ".join(own)))
            doc += 1
            for _ in range(chance.randint(0, 3)):
                own[chance.randrange(len(own))] = word()
    base = [word() for _ in range(80)]
    for _ in range(60):
        copy = list(base)
        copy[chance.randrange(80)] = word()
        rows.append((doc, " ".join(copy)))
        doc += 1
    rows += [(doc + i, t) for i, t in enumerate([None, "", " \n\t ", "", "One two", "one  TWO", "two one", "É a b c d e", "é a b c d e"])]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (None, "alone in the world here")]
    rows += [(doc + 50, "long " * 30_000), (doc + 51, " ".join(word() for _ in range(20_000)))]
    return rows


def test_equals_all_pairs(spark):
    rows = planted()
    assert run(spark, rows) == brute(rows)


def test_orders_do_not_change_the_result(spark):
    rows = planted(9)
    want = brute(rows)
    assert run(spark, rows, sample_rate=1, frequent_from=3) == want
    assert run(spark, rows, broadcast_rows=0) == want


def test_exact_part_alone_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "seed_pairs", lambda classes, percent: classes.select(classes.cls.alias("a"), classes.cls.alias("b")).limit(0))
    rows = planted(2)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_similar_sets_share_prefix_tokens_under_every_order():
    chance = np.random.default_rng(1)
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _ in range(200):
        n = int(chance.integers(1, 60))
        a = np.unique(chance.integers(0, 2**60, n).astype(np.uint64))
        keep = a[chance.random(len(a)) < 0.9]
        b = np.unique(np.concatenate([keep, chance.integers(0, 2**60, int(chance.integers(0, 6))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and both * 100 >= 75 * (len(a) + len(b) - both):
            for order in range(3):
                pa, pb = (prefix(x, order, *nothing, 75) for x in (a, b))
                rest = max(len(a) - len(pa), len(b) - len(pb))
                met = shared(np.sort(pa), np.sort(pb))
                assert met >= 1 and met + rest >= both


def test_sets():
    assert len(shingle_set(b"", 5)) == 0 and len(shingle_set(b"a b", 5)) == 1 and len(shingle_set(b"a b c d e f", 5)) == 2
    assert list(shingle_set(b"A\tb\nc  d E", 5)) == list(shingle_set(b"a b c d e", 5))
    assert [prefix_length(n, 75) for n in (1, 2, 4, 100)] == [1, 1, 2, 26]


def test_parities_never_rule_out_a_similar_pair():
    chance = np.random.default_rng(8)
    ruled_out = 0
    for n in (1, 40, 63, 64, 65, 128, 500, 1500):
        tokens = np.unique(chance.integers(0, 1 << 63, 2 * n).astype(np.uint64))
        for kept in (0.4, 0.8, 1.0):
            a, b = tokens[:n], np.concatenate([tokens[: int(n * kept)], tokens[n : n + n // 5]])
            apart = jaccard_join.least_difference(jaccard_join.parities(a), jaccard_join.parities(b))
            assert apart <= len(np.setxor1d(a, b))
            needed = -(-75 * (len(a) + len(b)) // 175)
            ruled_out += len(a) + len(b) - apart < 2 * needed
    assert ruled_out >= 6


def edited_copies(n, seed=3):
    """Copies of one text, each with one or two words changed: all link."""
    chance = random.Random(seed)
    word = lambda: "".join(chance.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for doc in range(n):
        copy = list(base)
        for _ in range(chance.randint(1, 2)):
            copy[chance.randrange(150)] = word()
        rows.append((doc, " ".join(copy)))
    return rows


def test_near_copies_that_seeds_miss_are_not_all_paired(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "seed_pairs", lambda classes, percent: classes.select(classes.cls.alias("a"), classes.cls.alias("b")).limit(0))
    made, found = [], jaccard_join.candidate_pairs

    def counted(*given):
        pairs = found(*given)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard_join, "candidate_pairs", counted)
    rows = edited_copies(120)
    assert run(spark, rows) == brute(rows)
    assert made[0] <= 10 * len(rows)


def test_exact_step_needs_neither_seeds_nor_leaders(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "seed_pairs", lambda classes, percent: classes.select(classes.cls.alias("a"), classes.cls.alias("b")).limit(0))
    monkeypatch.setattr(jaccard_join, "LEADER_ROUNDS", 0)
    rows = planted(4)
    assert run(spark, rows) == brute(rows)
