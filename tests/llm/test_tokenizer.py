"""Ids against a library's, with words looked up and encoded where they stand, and the exact round trip."""

import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from playledger.llm import tokenizer

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.vocabulary_path()), reason="no vocabulary")


@pytest.fixture(scope="module")
def library():
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    return [
        "", None, " ", "\n\n  x", "<|endoftext|> is text", "a" * 5000, " " * 333, "日本語のテキスト" * 60, "🏀🔥👨‍👩‍👧" * 9, "été NAÏVE don't WE'LL", "　 a b\x1c\x1dz\x85q",
        "".join(rng.choice("abcdefgh") for _ in range(2000)), "Привет, мир! 123456 7.5%", "same", "same", "x\r\ny\t\tz   ", "word " * 20_000,
    ]


@pytest.mark.parametrize("most", [10**6, 0, 5])
def test_ids_equal_the_library(spark, library, most):
    rows = list(enumerate(texts())) + [(None, "same"), (None, "other"), (13, "same")]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, _key int, word string")
    got = tokenizer.encode_column(df, "text", "ids", most=most).select("doc_id", "text", "ids", "_key", "word").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == (library.encode_ordinary(r.text) if r.text else []), (r.doc_id, r.text and r.text[:40])
    assert all(r._key == 1 and r.word == "w" for r in got)


def test_round_trip_and_counts(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    back = tokenizer.encode_column(df, "text", "ids").select("text", "ids", tokenizer.decode(F.col("ids")).alias("back"))
    assert all(r.back == (r.text or "") for r in back.collect())
    n = {r.doc_id: r.n_tokens for r in tokenizer.token_counts(df, "text", key="doc_id").collect()}
    assert n[0] == n[1] == 0 and n[13] == 1
    assert tokenizer.encode_column(df.limit(0), "text", "ids").count() == 0


def test_merges_rebuild_every_piece():
    path = tokenizer.vocabulary_path()
    ranks = tokenizer.vocabulary(path)
    by_id = {v: k for k, v in ranks.items()}
    found = tokenizer.merges(path)
    assert len(found) == len(ranks) - 256 and all(by_id[a] + by_id[b] == by_id[c] and a < c and b < c for a, b, c in found)
