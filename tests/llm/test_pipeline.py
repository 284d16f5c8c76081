"""The pipeline against a plain version of its rules, on documents with planted cases."""

import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from statloom.llm.bpe import read_ranks
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_line_dedup import brute as cut_lines


def test_stages_equal_the_plain_version(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    long_one = max((r.text for r in source.where("lang = 'en'").collect()), key=len)
    words = long_one.split()
    passage = " ".join(words[:70])
    planted = [
        (9001, long_one, "en", "p", 1), (9002, " ".join([*words[:40], "changed", *words[41:]]), "en", "p", 1),
        (9003, "Before this and that.\n" + passage + "\nAfter of the and.", "en", "p", 1),
        (9004, "Another one of the.\n" + passage + "\nMore of and the.", "en", "p", 1),
        (9005, "of the and " + items[0][1], "en", "p", 1), (9006, "12 34 -- !!", "en", "p", 1), (9007, None, "en", "p", 1),
        (9008, "", None, None, None), (9001, long_one, "en", "p", 1), (None, "that the and of was for this", "en", "p", 1),
    ]
    folder = str(tmp_path)
    docs = source.unionByName(spark.createDataFrame(planted, source.schema))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).columns == docs.columns, name

    # language: only the model's choice is taken from the stage, its rules are held below
    stage = dict(corpus_pipeline.STAGES)
    first = [tuple(r) for r in stage["language_id"](spark, docs, folder).select("doc_id", "text").collect()]
    everything = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    gone = [r for r in everything if r not in first]
    assert all(r in everything for r in first) and {9006, 9007, 9008} <= {r[0] for r in gone} and len(gone) <= 6

    cut = [(d, t) for d, t, n, dead in cut_lines(first, 120, 16) if not dead or t.strip(" ")]
    group = {}
    for doc, text in sorted(set(cut), key=lambda r: (r[0] is not None, r[0] or 0)):
        group.setdefault(doc, text)
    rows = sorted(set(cut), key=repr)
    named = components(rows)
    kept = [(d, t) for d, t in rows if d is None or not re.sub(r"\s", "", t) or (d, _size(t), d) in named]
    clean = {(d, n) for d, n, _, _, hit in leaks(kept, items) if not hit}
    final = [(d, t) for d, t in kept if (d, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))) in clean]

    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    want = sorted(((d, ",".join(map(str, encoding.encode_ordinary(t))), hashlib.sha256(t.encode()).hexdigest()) for d, t in final), key=repr)
    out = corpus_pipeline.run(spark, folder)
    got = sorted(((r.doc_id, ",".join(map(str, r.ids)), r.decoded_sha256) for r in out.collect()), key=repr)
    assert got == want
    ids = {r[0] for r in got}
    assert 9002 not in ids and 9005 not in ids and {9003, 9004} <= ids


def _size(text):
    words = text.encode().lower().split()
    return len({tuple(words[k : k + 5]) for k in range(len(words) - 4)}) or int(bool(words))


def test_long_runs_of_short_lines_are_cut_too(spark):
    run = "\n".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, run + "\none", "en", "p", 1), (2, run + "\ntwo", "en", "p", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    assert got == {1: run + "\none", 2: "two"}
