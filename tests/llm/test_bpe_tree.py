import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heapline.llm import bpe_tree


@pytest.fixture(scope="module")
def encoders():
    where = bpe_tree.default_vocabulary()
    return [bpe_tree.TreeEncoder(where, leaf, window) for leaf, window in ((10**9, 8), (2, 1), (5, 2), (64, 8))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abest '\n\t12!,.é日本語🙂　 _Ω", "'s", "\u0301", "\u200b", "th", "ing"]), max_size=120).map("".join) | st.text(max_size=80))
def test_tree_equals_the_tokenizer(encoders, text):
    text = text.encode("utf-8", "ignore").decode()
    want = encoders[0].enc.encode_ordinary(text)
    for e in encoders:
        assert e.encode(text) == want
    assert encoders[0].decode(want) == text


def test_long_runs(encoders):
    rng = random.Random(7)
    for text in ("a" * 5000, "ab" * 3000, "".join(rng.choice("etaoin") for _ in range(6000)), " " * 3001 + "x", "\n \n" * 900, "'s" * 800, "don't'll" * 300, "中文字" * 1500, "1234567890" * 400, "!?" * 2000):
        want = encoders[0].enc.encode_ordinary(text)
        assert all(e.encode(text) == want for e in encoders)


def test_same_ids_as_the_other_library(encoders):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_tree.default_vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ("Hello, world! <|endoftext|>", " zwei  Wörter\r\n\tund 中文。 'tis", "x" * 300):
        assert t.encode(text, add_special_tokens=False).ids == encoders[1].encode(text)


def test_corpus(spark):
    rows = [(1, "some text", 1), (2, "", 2), (3, None, 3), (3, "again", 4), (None, "no key", 5), (4, "long " * 40000, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = bpe_tree.encode_corpus(df, leaf_chars=1000)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    enc = bpe_tree.TreeEncoder(bpe_tree.default_vocabulary(), 10**9)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got.collect()) == sorted((str(k), tuple(enc.encode(t))) for k, t, _ in rows)
    assert bpe_tree.encode_corpus(df.limit(0)).count() == 0
