import random
import re

from statloom.llm.decontaminate import find_leaks


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((doc, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, n_words string").repartition(2)
    i = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, text2 string")
    got = find_leaks(d, i, **options).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_equals_brute_force(spark):
    chance = random.Random(8)
    word = lambda: chance.choice("a b c d e é the of zz 1".split())
    items = [(i, " ".join(word() for _ in range(chance.randint(0, 25)))) for i in range(30)]
    items += [(40, None), (41, "rare Word"), (42, "a b c d e é the of zz 1 a b"), (42, "a b c d e é the of zz 1 a b"), (None, "null item words")]
    docs = []
    for doc in range(40):
        text = [word() for _ in range(chance.randint(0, 40))]
        for _ in range(chance.randint(0, 2)):
            source = words(items[chance.randrange(len(items))][1])
            at = chance.randint(0, len(source))
            text[chance.randint(0, len(text)) : 0] = source[at : at + chance.randint(5, 14)]
        docs.append((doc, chance.choice([" ", ", ", "\n"]).join(text)))
    docs += [(None, "x rare word y"), (None, None), (50, ""), (50, "rare-word"), (50, "rare-word"), (51, "rare"), (52, "a " * 30_000 + "rare word")]
    want = [r for r in brute(docs, [i for i in items if i[0] is not None])]
    got = run(spark, docs, items)
    null_item = [r for r in got if "null" not in r[3]]
    assert null_item == want
    assert run(spark, docs, items, block=7) == got


def test_without_items_or_documents(spark):
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [], False)]
    assert run(spark, [(1, "a b")], [(1, None), (2, "...")]) == [(1, 2, 0, [], False)]
    assert run(spark, [], [(1, "a b")]) == []
