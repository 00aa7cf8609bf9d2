from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from fathom.llm import packing
from fathom.llm.bpe import encode_bpe
from fathom.llm.packing import Packer, pack, token_lengths
from fathom.llm.queries import QUERIES
from fathom.llm.shared import written
from tests.llm.helpers import SF


def brute_place(sizes, capacity, most):
    """The rule by plain search over the list of open windows."""
    windows, made, out = [], 0, []
    for s in sizes:
        fits = [(w["room"], w["no"]) for w in windows if w["room"] >= s]
        if fits:
            w = next(w for w in windows if w["no"] == min(fits)[1])
        else:
            if len(windows) >= most:
                windows.remove(min(windows, key=lambda w: (w["room"], w["no"])))
            w = {"no": made, "room": capacity}
            made += 1
            windows.append(w)
        out.append((w["no"], capacity - w["room"]))
        w["room"] -= s
        if not w["room"]:
            windows.remove(w)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=60), st.integers(1, 4))
def test_packer(sizes, most):
    p = Packer(10, most)
    assert [p.place(s)[:2] for s in sizes] == brute_place(sizes, 10, most)


def check(rows, lengths, capacity):
    windows, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.window_id].append((r.window_offset, r.n_tokens))
        docs[r.doc_id].append((r.doc_start, r.n_tokens))
    for spans in windows.values():  # no holes, no overlaps, within the window
        end = 0
        for at, n in sorted(spans):
            assert at == end and n > 0
            end += n
        assert end <= capacity
    for d, n in lengths.items():
        assert sum(k for _, k in docs[d]) == n
        end = 0
        for at, k in sorted(docs[d]):
            assert at == end
            end += k
    return windows


def test_pack(spark):
    rows = [(i, (i * 37) % 150, "x") for i in range(1, 2000)] + [(5000, 100, "x"), (5001, 250, None), (5002, None, None), (5003, 0, "x"), (5004, -4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, window_id string").repartition(7)
    out = pack(df, capacity=100, most_open=4).collect()
    lengths = {d: n for d, n, _ in rows if n and n > 0}
    windows = check(out, lengths, 100)
    assert {r.doc_id for r in out} == set(lengths)
    full = sum(lengths.values()) / (100 * len(windows))
    assert full > 0.9
    grouped = check(pack(df, capacity=100, most_open=4, group=3).collect(), lengths, 100)
    assert len(grouped) >= len(windows)
    twice = pack(spark.createDataFrame([(1, 60), (1, 60)], "doc_id long, n_tokens int"), capacity=100).collect()
    assert len(twice) == 2 and len({r.window_id for r in twice}) == 2
    assert twice[0].row_id != twice[1].row_id
    assert pack(df.limit(0)).count() == 0
    named = spark.createDataFrame([(7, 60)], "ROW_ID long, n_tokens int")
    assert pack(named, id_col="ROW_ID").columns[0] == "ROW_ID_in" and pack(named, id_col="ROW_ID").first()[0] == 7


def test_tokens(spark):
    """With ids every piece has its own, and the windows are the same."""
    rows = [(i, None if i % 50 == 3 else list(range(i, i + (i * 37) % 150))) for i in range(600)] + [(5001, list(range(250))), (5001, list(range(250, 500)))]
    df = spark.createDataFrame(rows, "doc_id long, token_ids array<int>").repartition(5)
    out = pack(df, ids_col="token_ids", capacity=100, most_open=4).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r.doc_start):
        assert len(r.token_ids) == r.n_tokens
        got[r.doc_id, r.row_id] += r.token_ids
    assert sorted((d, t) for (d, _), t in got.items()) == sorted((d, t) for d, t in rows if t)
    windows = defaultdict(int)
    for r in out:
        windows[r.window_id] += r.n_tokens
    assert max(windows.values()) <= 100
    plain = pack(df.selectExpr("doc_id", "size(token_ids) AS n_tokens"), capacity=100, most_open=4).drop("row_id", "doc_id").collect()
    assert sorted(tuple(r) for r in plain) == sorted((r.window_id, r.window_offset, r.doc_start, r.n_tokens) for r in out)


def test_texts(spark, monkeypatch):
    """Texts are packed as their ids are, in one Python step, whatever is encoded at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).coalesce(1).select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(7, None), (None, "a b"), (8, ""), (9, "twice"), (9, "twice")], "doc_id long, text string")).coalesce(1)
    want = sorted(map(tuple, pack(encode_bpe(docs, keep=["doc_id"]), ids_col="token_ids", capacity=100, most_open=4).collect()), key=str)
    for most in (packing.TEXT_MOST, 50):
        monkeypatch.setattr(packing, "TEXT_MOST", most)
        monkeypatch.setattr(packing, "TOKENS_MOST", most)
        out = pack(docs, text_col="text", capacity=100, most_open=4)
        assert sorted(map(tuple, out.collect()), key=str) == want
    assert pack(docs.limit(0), text_col="text").count() == 0


def test_pipeline_packs_in_one_python_step(spark, monkeypatch):
    """A second worker a core with another copy of the batches took an executor's memory."""
    plans = []
    monkeypatch.setattr(packing, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or written(df, name))
    corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert plans[0].partition("Physical Plan")[2].count("MapInArrow") == 1


def test_partition_by_brute_force(spark):
    """One partition's windows against the plain rule, leftovers merged largest first."""
    sizes = [(i * 7919) % 97 + 1 for i in range(400)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens int").coalesce(1)
    got = {r.doc_id: (r.window_id, r.window_offset) for r in pack(df, capacity=100, most_open=5).collect()}
    placed = brute_place(sizes, 100, 5)
    # the windows open at the end, by replaying the rule
    windows = []
    for (w, at), s in zip(placed, sizes):
        if at == 0:
            if len(windows) >= 5:
                windows.remove(max(windows, key=lambda v: (v[1], -v[0])))
            windows.append([w, 0])
        v = next(v for v in windows if v[0] == w)
        v[1] += s
        if v[1] == 100:
            windows.remove(v)
    into = {}
    merged = []
    for w, n in sorted(windows, key=lambda v: (-v[1], v[0])):
        fits = [m for m in merged if m[1] + n <= 100]
        m = max(fits, key=lambda m: m[1]) if fits else None
        if m is None:
            m = [w, 0]
            merged.append(m)
        into[w] = (m[0], m[1])
        m[1] += n
    assert got == {i: (into.get(w, (w, 0))[0], at + into.get(w, (w, 0))[1]) for i, (w, at) in enumerate(placed)}


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.n_tokens for r in token_lengths(docs, keep=["doc_id"]).collect()}
    check(QUERIES["op5_packing"](spark, SF).collect(), want, 2048)
