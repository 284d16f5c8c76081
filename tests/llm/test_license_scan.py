import random
import re

from statloom.llm.license_scan import BASE_PHRASES, NOTICES, LicenseAutomaton, scan_licenses
from statloom.llm.text import ascii_words


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_matching_statistics_are_the_longest_template_runs():
    automaton = LicenseAutomaton(BASE_PHRASES, NOTICES)
    runs = {tuple(t[i:j]) for t in automaton.templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    words = ascii_words(b"the gnu general public license either version 2 of the License or the mit license. apache LICENSE by cc by 4 0")
    got = {place: length for place, _, length in automaton.statistics(words)}
    for place in range(len(words)):
        longest = max((k for k in range(1, place + 2) if tuple(words[place - k + 1 : place + 1]) in runs), default=0)
        assert got.get(place, 0) == longest


def test_phrases_equal_brute_force_on_cases_and_documents(spark, small):
    texts = [
        None, "", " \n ", "MIT License", "the mit  license; MIT LICENSE!", "cc by cc by cc-by", "gnu general\npublic license",
        "gnu general gnu general public license", "é mit licensé mit license", "mit license mit license",
        "x " * 60_000 + "Apache License", "apache license " * 3_000,
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "mit license", "x"), (3, "MIT License", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    for frame in (docs, documents):
        want = sorted(((r.doc_id, *brute(r.text)) for r in frame.collect()), key=repr)
        got = sorted(
            ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan_licenses(frame).collect()),
            key=repr,
        )
        assert got == want


def test_spans_survive_small_changes(spark):
    notice = NOTICES[1][1]
    changed = notice.replace("this file", "this one file").replace("compliance", "keeping")
    docs = spark.createDataFrame(
        [(1, "intro " + changed + " outro"), (2, "you may not use this")], "doc_id long, text string"
    )
    one, two = sorted(scan_licenses(docs).collect())
    assert "apache-2.0" in one.labels.split(",") and one.score == 1.0
    assert max(s.coverage for s in one.spans) >= 0.75
    assert two.labels == "" and 0 < two.score < 0.75


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_notice_within_a_longer_run_of_another_keeps_its_match():
    automaton = LicenseAutomaton(BASE_PHRASES, NOTICES)
    for text in (NOTICES[0][1] + ". The author wrote it", NOTICES[0][1] + ' (the "License") and more'):
        got = automaton.scan(ascii_words(text.encode()), 3, 12, 0.75)
        assert "apache-2.0" in got["labels"]
        assert {"label": "apache-2.0", "first_word": 0, "last_word": 7, "covered": 8, "coverage": 1.0} in got["spans"]
    # the words before go on in another template, too
    inner = LicenseAutomaton({}, [("long", "one two three four five six seven eight nine ten"), ("short", "three four five")])
    assert inner.scan(ascii_words(b"one two three four five six"), 3, 12, 0.75)["labels"] == ["short"]


def test_pieces_are_the_maximal_runs_of_each_template():
    chance = random.Random(3)
    notices = [(str(n), " ".join(chance.choice("abc") for _ in range(12))) for n in range(4)]
    automaton = LicenseAutomaton({}, notices)
    automaton._chain = lambda pieces, *_: ([], pieces)
    for _ in range(200):
        words = [chance.choice("aabbccx") for _ in range(30)]
        want = {}
        for number, (_, text) in enumerate(notices):
            own = text.split()
            for i in range(len(words)):
                for k in range(len(own)):
                    if i and k and words[i - 1] == own[k - 1]:
                        continue
                    size = next(n for n in range(31) if i + n == len(words) or k + n == len(own) or words[i + n] != own[k + n])
                    if size >= 3:
                        want.setdefault(number, set()).add((i, k, size))
        pieces = automaton.scan([w.encode() for w in words], 3, 12, 0.75)["score"]
        assert {n: set(p) for n, p in pieces.items()} == want and all(len(p) == len(set(p)) for p in pieces.values())
