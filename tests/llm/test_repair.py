import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.llm.bpe import BpeVocab, Encoder, encode_bpe
from fathom.llm.queries import QUERIES
from fathom.llm.repair import LONGEST, compress, compress_ids, decode_span, decompress, expand, pack_ints, shard_of, unpack_ints
from tests.llm.helpers import SF


def open_by_hand(symbol, g):
    if symbol < g["first"]:
        return [symbol]
    r = symbol - g["first"]
    return open_by_hand(g["left"][r], g) + open_by_hand(g["right"][r], g)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=8))
def test_exact_and_random_access(docs):
    flat = np.array([i for d in docs for i in d], np.int32)
    g = compress(flat, np.cumsum([len(d) for d in docs]), least=2)
    assert list(expand(g["symbols"], g)) == list(flat)
    for r in range(len(g["left"])):
        assert len(open_by_hand(g["first"] + r, g)) == g["length"][r]
    for k, d in enumerate(docs):
        assert list(decode_span(g, k)) == d
        for a in (0, 1, len(d) // 2):
            assert list(decode_span(g, k, a, a + 5)) == d[a : a + 5]


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 200, rng.integers(2, 9)) for _ in range(30)]
    flat = np.concatenate([words[i] for i in rng.integers(0, 30, 20000)])
    g = compress(flat, np.array([len(flat)]), least=8)
    s = g["symbols"].astype(np.int64)
    pairs, n = np.unique((s[:-1] << 32) | s[1:], return_counts=True)
    equal = (pairs >> 32) == (pairs & 0xFFFFFFFF)  # of aa a run of three counts twice and is replaced once
    assert n[~equal].max() < 8 + 2 and len(s) < len(flat) / 4


def test_passages_of_few_documents():
    """What three documents share is replaced too, by default; no pair that occurs so often is left, whatever the hashes do, and it pays in bytes."""
    rng = np.random.default_rng(5)
    shared = [rng.integers(0, 50000, 200) for _ in range(300)]
    docs = [np.concatenate([shared[k], rng.integers(0, 50000, 100)]) for k in np.repeat(np.arange(300), 3)]
    flat, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    g = compress(flat, ends)
    assert (expand(g["symbols"], g) == flat).all()
    inside = np.ones(len(g["symbols"]) - 1, bool)
    inside[g["offsets"][1:-1] - 1] = False
    s = g["symbols"].astype(np.int64)
    pairs, n = np.unique(((s[:-1] << 32) | s[1:])[inside], return_counts=True)
    assert n[(pairs >> 32) != (pairs & 0xFFFFFFFF)].max() < 3 and len(s) < 0.4 * len(flat)
    assert sum(len(pack_ints(g[k])) for k in ("left", "right", "length", "symbols")) < len(pack_ints(flat))


def left_over(g, ends):
    """The greatest count of a pair of different symbols within documents, short enough for a rule."""
    s, length = g["symbols"].astype(np.int64), np.concatenate([np.ones(g["first"], np.int64), g["length"]])
    inside = np.ones(max(len(s) - 1, 0), bool)
    cuts = g["offsets"][1:-1]
    inside[cuts[(cuts > 0) & (cuts < len(s))] - 1] = False
    a, b = s[:-1][inside], s[1:][inside]
    fits = (a != b) & (length[a] + length[b] <= LONGEST)
    return np.unique((a << 32 | b)[fits], return_counts=True)[1].max(initial=0)


def test_real_text():
    """No frequent pair is left of the ids of real documents, counted by sorting; ids of any size give the same grammar."""
    d = pd.read_parquet(f"{SF}/documents.parquet")
    flat, counts = Encoder(BpeVocab.from_file()).encode(list(d.text))
    ends = np.cumsum(counts)
    for least in (3, 8):
        g = compress(flat, ends, least)
        assert left_over(g, ends) < least and (expand(g["symbols"], g) == flat).all()
    far = compress(2**31 - 1 - flat, ends)
    assert len(far["symbols"]) == len(compress(flat, ends)["symbols"]) or left_over(far, ends) < 3
    assert (expand(far["symbols"], far) == 2**31 - 1 - flat).all() and far["first"] < 60000
    assert list(decode_span(far, 5, 3, 9)) == list((2**31 - 1 - flat[ends[4] : ends[5]])[3:9])


def test_ints():
    for x in ([], [0], [255, 256], [70000, 2**31 - 1]):
        assert list(unpack_ints(pack_ints(np.array(x, np.int32)))) == x


def test_frames(spark):
    rows = [(1, None, 7), (2, [], 7), (3, [5] * 100000, 7), (4, [1, 2, 3] * 50, 7), (4, [1, 2, 3] * 50, 7), (None, [9], None)]
    df = spark.createDataFrame(rows, "doc_id long, token_ids array<int>, n_docs int")
    for most in (2_000_000, 120):
        got = sorted(((r.doc_id, r.token_ids) for r in decompress(compress_ids(df, shard_tokens=most)).collect()), key=str)
        assert got == sorted(((i, t) for i, t, _ in rows), key=str)
    assert compress_ids(df.limit(0)).count() == 0
    big = spark.createDataFrame([(1, [2**31 - 1, 5, 2**31 - 1, 5] * 9, 7)], "doc_id long, token_ids array<int>, nulls int")
    assert decompress(compress_ids(big)).first().token_ids == [2**31 - 1, 5, 2**31 - 1, 5] * 9
    with pytest.raises(Exception, match="non-negative"):
        compress_ids(spark.createDataFrame([(1, [-1])], "doc_id long, token_ids array<int>")).collect()


def test_query(spark):
    shards = QUERIES["op4_repair"](spark, SF)
    rows = shards.collect()
    assert all(r.intact for r in rows) and sum(r.n_symbols + 2 * r.n_rules for r in rows) < 0.6 * sum(r.n_tokens for r in rows)
    want = {r.doc_id: r.token_ids for r in encode_bpe(spark.read.parquet(f"{SF}/documents.parquet"), keep=["doc_id"]).collect()}
    assert {r.doc_id: r.token_ids for r in decompress(shards).collect()} == want
    g, ids = shard_of(rows[0].asDict()), rows[0].doc_ids
    assert list(decode_span(g, 3, 10, 20)) == want[ids[3]][10:20]
