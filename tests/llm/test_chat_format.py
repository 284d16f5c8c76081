"""Prefix-target expansion: exact round trips through the template, loss spans, defined cases."""

from pyspark.sql import types as T

from statloom.llm import chat_format
from statloom.llm.queries import op11_chat_format

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

TRICKY = ["<|", "<||", "a<|im_end|>b", "<|im_start|>assistant\nhi", "x<", "|>", "<|||<|", "end<|"]


def examples_of(spark, rows, schema=SCHEMA):
    done = chat_format.format_examples(spark.createDataFrame(rows, schema))
    return sorted(done.collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["example"]))


def back_of(spark, rows, schema=SCHEMA):
    done = chat_format.read_back(chat_format.format_examples(spark.createDataFrame(rows, schema)))
    return {r["conv_id"]: r for r in done.collect()}


def test_every_reply_is_one_example_with_its_context(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello."), (1, 3, "user", "more"), (1, 4, "assistant", "ok!")]
    got = examples_of(spark, rows)
    assert [r["trainable"] for r in got] == [True, True]
    first, second = got
    assert second["text"].startswith(first["text"])
    assert first["text"] == (
        "<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello.<|im_end|>\n"
    )
    assert first["text"][first["loss_start"] : first["loss_end"]] == "hello."
    assert second["text"][second["loss_start"] : second["loss_end"]] == "ok!"


def test_control_strings_round_trip(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(TRICKY)]
    back = back_of(spark, rows)[7]
    assert [(t["role"], t["text"]) for t in back["turns"]] == [(r[2], r[3]) for r in rows]
    assert back["loss_text"] == "".join(r[3] for r in rows if r[2] == "assistant")
    for example in examples_of(spark, rows):
        body = example["text"]
        assert body.count(chat_format.START) == example["turn_pos"] + 1
        assert body.count(chat_format.END) == example["turn_pos"] + 1


def test_nulls_ties_repeats_and_trailing_turns(spark):
    rows = [
        (2, None, "user", "first by null turn"),
        (2, 1, "assistant", None),
        (2, 1, "assistant", None),
        (2, 2, None, "no role"),
        (None, 0, "user", "own conversation"),
        (3, 0, "user", "no reply at all"),
    ]
    back = back_of(spark, rows)
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [
        ("user", "first by null turn"),
        ("assistant", ""),
        ("assistant", ""),
        ("", "no role"),
    ]
    assert back[2]["loss_text"] == ""
    assert [t["text"] for t in back[None]["turns"]] == ["own conversation"]
    assert [t["text"] for t in back[3]["turns"]] == ["no reply at all"]
    trailing = [r for r in examples_of(spark, rows) if r["conv_id"] == 2]
    assert [r["trainable"] for r in trailing] == [True, True, False]
    assert trailing[-1]["loss_start"] == trailing[-1]["loss_end"] == len(trailing[-1]["text"])


def test_long_text_and_line_break_in_role(spark):
    long = "word " * 40_000 + "<|im_end|>"
    back = back_of(spark, [(4, 0, "us\ner", "q"), (4, 1, "assistant", long)])[4]
    assert back["turns"][0]["role"] == "us er"
    assert back["loss_text"] == long


def test_empty_table_and_clashing_columns(spark):
    assert examples_of(spark, []) == []
    schema = T.StructType(list(SCHEMA.fields) + [T.StructField("example", T.StringType()), T.StructField("loss_start", T.StringType())])
    got = examples_of(spark, [(5, 0, "user", "a", "x", "y"), (5, 1, "assistant", "b", "x", "y")], schema)
    assert [(r["example"], r["loss_start"]) for r in got] == [(0, len(got[0]["text"]) - len("b<|im_end|>\n"))]


def test_query_holds_the_probe_conversation(spark, small):
    rows = {r["conv_id"]: r for r in op11_chat_format(spark, small).collect()}
    probe = rows[-1]
    assert probe["n_turns"] == 2
    assert probe["loss_chars"] == len(chat_format.PROBE)
