import random

import pytest
import tiktoken

from codestrata.llm import tokens as T

SPECIAL = ["<|endoftext|> is plain", "", None, "aaaa" * 500, "ab" * 700, "don't we'll\r\n  x", "naïve 😀 text 中文 ไทย", "x" * 9000, "0123456789" * 300, "​\x00\x07 ok", " \t\n  "]


@pytest.fixture(scope="module")
def pair():
    ranks = T.read_ranks(T.VOCABULARY)
    return T.Encoder(ranks), tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _split(enc, texts):
    flat, ends = enc.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_same_as_library(pair):
    enc, ref = pair
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aabbcdeé中🙂 \n'0-") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    texts = SPECIAL + words + ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)) for _ in range(3)]
    assert _split(enc, texts) == [ref.encode_ordinary(x) if x else [] for x in texts]


def test_cache_bound(pair):
    small = T.Encoder(T.read_ranks(T.VOCABULARY), keep=3)
    assert _split(small, ["one two three", "four five"]) == _split(pair[0], ["one two three", "four five"])
    assert _split(small, ["six seven", "one"]) == _split(pair[0], ["six seven", "one"])


def test_query(spark, tmp_path, pair):
    rows = [(i, x, "noise") for i, x in enumerate(SPECIAL)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in T.encode_column(df, "doc_id", "text").collect()}
    assert got == {i: pair[1].encode_ordinary(x) if x else [] for i, x in enumerate(SPECIAL)}
    assert T.encode_column(df.limit(0), "doc_id", "text").count() == 0
