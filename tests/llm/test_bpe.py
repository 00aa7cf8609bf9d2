import base64
import random
import time

import pandas as pd
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.llm.bpe import DEFAULT_VOCAB, PATTERN, BpeVocab, Encoder, decode_bpe, encode_bpe
from fathom.llm.queries import QUERIES
from tests.llm.helpers import SF

RANKS = DEFAULT_VOCAB.replace(".json", ".tiktoken")


@pytest.fixture(scope="module")
def vocab():
    return BpeVocab.from_file()


@pytest.fixture(scope="module")
def brute():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "a" * 3000, "".join(random.Random(4).choices("etaoinshrdlu", k=9000)), "ab" * 700 + "abc" * 300, "ab" * 400 + "²Ⅷx 12\x1cz  \n\n q", "'s 'll it's\t\t y", "é" * 300, "日本語 text 🙂🙂", "x_y __init__ 3½", "　　a"]


def test_same_ids_as_public_library(vocab, brute):
    enc = Encoder(vocab)
    flat, counts = enc.encode(ODD)
    at = 0
    for text, n in zip(ODD, counts):
        assert list(flat[at : at + n]) == brute.encode_ordinary(text), text[:40]
        at += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_property(vocab, brute, texts):
    flat, counts = Encoder(vocab).encode(texts)
    assert list(flat) == [i for t in texts for i in brute.encode_ordinary(t)]
    assert flat.size == counts.sum()


def test_rank_file_gives_same_merges(vocab):
    other = BpeVocab.from_file(RANKS)
    assert (other.merged == vocab.merged).all()


def test_frames(spark, vocab):
    rows = [(1, None, "k", 9), (2, "", "k", 9), (3, "the cat", "k", 9), (3, "the cat", "k", 9), (None, "naïve 🙂 " * 2000, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string, N_TOKENS int")
    out = encode_bpe(df, vocab, verify=True)
    assert [c.lower() for c in out.columns].count("n_tokens") == 1 and "extra" in out.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].token_ids is None and got[1].round_trip is None and got[1].n_tokens is None
    assert got[2].token_ids == [] and got[2].n_tokens == 0 and got[2].round_trip
    assert out.filter("not round_trip").count() == 0
    assert out.filter("doc_id = 3").count() == 2
    back = decode_bpe(out.withColumn("was", F.col("text")), vocab)
    assert back.filter("not (text <=> was)").count() == 0
    assert encode_bpe(df.limit(0), vocab).count() == 0


def test_bad_ids(spark, vocab):
    df = spark.createDataFrame([(1, [999999])], "doc_id long, token_ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        decode_bpe(df, vocab).collect()


def test_a_megabyte_without_a_blank(vocab):
    text = "".join(random.Random(5).choices("etaoinshrdlu", k=1_000_000))
    began = time.process_time()
    flat, counts = Encoder(vocab).encode([text])
    assert time.process_time() - began < 60 and vocab.decode_flat(flat)[0].tobytes().decode() == text


def test_query(spark, brute):
    """The ids of every document are those of the public library."""
    got = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, SF).collect()}
    d = pd.read_parquet(f"{SF}/documents.parquet")
    assert len(got) == len(d)
    for i, text in zip(d.doc_id, d.text):
        assert got[i].token_ids == brute.encode_ordinary(text) and got[i].n_tokens == len(got[i].token_ids) and got[i].round_trip
