import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from statloom.llm.bpe import Codec, PrefixEncoder, encode_texts, read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
CODEC = Codec(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(text):
    return [int(i) for _, ids, _ in CODEC.encode(text) for i in ids.split(",")]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_library_on_any_text(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids_of(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="thein gaoédöü \n'sABC12", max_size=120))
def test_equals_the_library_on_wordlike_text(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("code", range(0, 0x250, 7))
def test_character_classes(code):
    c = chr(code)
    for text in (f"a{c}b", f" {c}{c} 1{c}", f"'{c}"):
        assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_appends_and_edits_are_exact():
    chance = random.Random(3)
    parts = [b"th", b"e", b"in", b"g", b"a", b"\xc3\xa9", b"tion"]
    for _ in range(60):
        data = b"".join(chance.choice(parts) for _ in range(300))
        grown = PrefixEncoder(CODEC.vocabulary)
        for i in range(0, len(data), 17):
            grown.append(data[i : i + 17])
            assert grown.last == PrefixEncoder(CODEC.vocabulary, data[: i + 17]).last
        start = chance.randint(0, len(data))
        end = chance.randint(start, min(len(data), start + 9))
        new = chance.choice([b"", b"the", b"xyz" * 5])
        computed = grown.edit(start, end, new)
        assert grown.tokens() == PrefixEncoder(CODEC.vocabulary, data[:start] + new + data[end:]).tokens()
        assert computed < len(grown.data) or start < 200


def test_table_of_texts(spark, small):
    texts = [None, "", " ", "a", "a" * 20_000, "word " * 20_000, "日本語 🙂 don't"]
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [(None, "a", "kept"), (None, "a", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    for frame in (docs, spark.read.parquet(f"{small}/documents.parquet")):
        got = encode_texts(frame, PATH, public_tokenizers.PATTERN)
        texts_of = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=repr)
        want = [
            (i, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), t, hashlib.sha256(t.encode()).hexdigest())
            for i, t in texts_of
            for e in [LIBRARY.encode_ordinary(t)]
        ]
        rows = got.select("doc_id", "n_tokens", "ids_sha256", "decoded", "decoded_sha256").collect()
        assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert encode_texts(docs.limit(0), PATH, public_tokenizers.PATTERN, keep_others=True).count() == 0


def test_what_is_remembered_stays_small():
    """A worker keeps its codec while later jobs run in it."""
    chance = random.Random(5)
    words = ["".join(chance.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(40_000)]
    codec, text = Codec(RANKS, public_tokenizers.PATTERN), " ".join(words)
    tracemalloc.start()
    found = codec.encode(text)
    assert [int(i) for _, ids, _ in found for i in ids.split(",")] == LIBRARY.encode_ordinary(text)
    del found
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 32_000_000


def test_pieces_met_again_stay_remembered():
    codec, encoded = Codec(RANKS, public_tokenizers.PATTERN, 200), []
    whole = codec.encode_piece
    codec.encode_piece = lambda piece: encoded.append(piece) or whole(piece)
    for i in range(2000):
        text = f" zqxjkv {chr(97 + i % 26)}zq{chr(97 + i // 26 % 26)}xj{chr(97 + i // 676)}"
        assert [int(i) for _, ids, _ in codec.encode(text) for i in ids.split(",")] == LIBRARY.encode_ordinary(text)
        assert len(codec.known) <= 200
    assert encoded.count(b" zqxjkv") == 1
