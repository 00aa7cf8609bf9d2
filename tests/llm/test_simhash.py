import hashlib
import math
import re
import struct
from collections import defaultdict

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.llm import simhash
from fathom.llm.queries import QUERIES
from fathom.llm.simhash import MAX_DISTANCE, Fingerprinter, as_words, components, drop_copies, find_copies, forest, gray_rank, near_edges, tables_for
from tests.llm.helpers import SF


def groups(n, edges):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def brute_pairs(x, group, most):
    for i in range(len(x)):
        d = np.bitwise_count(x[:i] ^ x[i]).sum(1)
        for j in np.flatnonzero((d <= most) & (group[:i] == group[i])):
            yield i, j


def test_gray_rank():
    n = np.arange(5000, dtype=np.uint64)
    x = np.stack([np.zeros(5000, np.uint64), n ^ (n >> np.uint64(1))], 1)
    assert (gray_rank(x)[:, 1] == n).all()
    big = [(1 << 64) + 5, (1 << 127) + 12345, (1 << 128) - 1]
    for v in big:
        g = v ^ (v >> 1)
        r = gray_rank(np.array([[g >> 64, g & (2**64 - 1)]], np.uint64))[0]
        assert (int(r[0]) << 64) + int(r[1]) == v


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 300), st.integers(1, 5))
def test_index_is_exact(seed, n, k):
    rng = np.random.default_rng(seed)
    seeds = rng.integers(0, 2**63, (max(1, n // 10), 2)).astype(np.uint64)
    x = seeds[rng.integers(0, len(seeds), n)].copy()
    for _ in range(6):
        x[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    group = rng.integers(0, k, n)
    want = groups(n, brute_pairs(x, group, 7))
    got = groups(n, zip(*forest(x, group, 7, block=500)))
    assert got == want


def slow_fingerprint(text):
    """The definition, bit by bit."""
    w = re.findall(r"\w+", text.lower())
    if not w:
        return hashlib.blake2b(text.encode(), digest_size=16).digest()
    digest = lambda x: hashlib.blake2b(x.encode(), digest_size=16).digest()

    def pair(a, b):
        out, full = b"", 2**64 - 1
        for x, y in zip(struct.unpack("<2Q", digest(a)), struct.unpack("<2Q", digest(b))):
            m = (x * 0x9E3779B97F4A7C15 + (y ^ (y >> 29)) * 0xBF58476D1CE4E5B9) & full
            m = (m ^ (m >> 31)) * 0x94D049BB133111EB & full
            out += struct.pack("<Q", m ^ (m >> 30))
        return out

    total = [0] * 128
    for weight, hashes in ((2, map(digest, set(w))), (1, [pair(a, b) for a, b in set(zip(w, w[1:]))])):
        for raw in hashes:
            h = int.from_bytes(raw, "big")
            for k in range(128):
                total[k] += weight if h >> (127 - k) & 1 else -weight
    return sum(1 << (127 - k) for k in range(128) if total[k] > 0).to_bytes(16, "big")


def test_fingerprints_by_definition():
    texts = ["", "--", "One", "the dog bites the man", "é ü é ü x " * 400, " ".join(f"w{i}" for i in range(700))]
    assert Fingerprinter()([*texts, None]) == [*map(slow_fingerprint, texts), None]


def test_small_words_numbers_and_order_count():
    texts = [
        "This drug is safe for children under 12 years, take 5 mg.", "This drug is not safe for children under 99 years, take 500 mg.",
        "the dog bites the man who sold a house", "a man bites the dog who sold the house",
    ]
    safe, unsafe, one, other = as_words(np.frombuffer(b"".join(Fingerprinter()(texts)), np.uint8).reshape(-1, 16))
    assert min(np.bitwise_count(a ^ b).sum() for a, b in ((safe, unsafe), (one, other))) > MAX_DISTANCE


def test_against_brute_force(spark):
    """All pairs within the distance over all documents of sf0.1; nothing is grouped that shouldn't be."""
    d = pd.read_parquet("/root/testdata/sf0.1/documents.parquet")
    some = d.iloc[::250]
    assert Fingerprinter()(list(some.text)) == [slow_fingerprint(t) for t in some.text]
    x = as_words(np.frombuffer(b"".join(Fingerprinter()(list(d.text))), np.uint8).reshape(-1, 16))
    pairs = list(brute_pairs(x, np.zeros(len(x)), MAX_DISTANCE))
    out = QUERIES["op6_simhash"](spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id").loc[d.doc_id]
    g = out.group_id.to_numpy()
    differ = np.array([(i, j, np.bitwise_count(x[i] ^ x[j]).sum()) for i, j in pairs if (x[i] != x[j]).any()], np.int64)
    found = g[differ[:, 0]] == g[differ[:, 1]]
    assert np.mean([g[i] == g[j] for i, j in pairs]) > 0.97 and len(differ) > 500 and found.mean() > 0.97
    assert found[differ[:, 2] > MAX_DISTANCE - 4].mean() > 0.93
    full = groups(len(x), pairs)
    mine = defaultdict(set)
    for i, v in enumerate(g):
        mine[v].add(full[i])
    assert all(len(v) == 1 for v in mine.values())
    assert out.kept.sum() == out.group_id.nunique() == len(mine)


def clusters(seed, n, flips):
    """Fingerprints around few centres, and lonely ones."""
    rng = np.random.default_rng(seed)
    bits = rng.random((n, 128)) < 0.5
    centre = bits[rng.integers(0, 20, n // 2)]
    bits[: n // 2] = centre ^ (rng.random((n // 2, 128)) < flips / 128)
    return np.unique(np.packbits(bits, axis=1), axis=0)


def test_large_groups_are_divided():
    """A group too large for one search loses few links."""
    raw = clusters(1, 6000, 6)
    x, one = as_words(raw), np.zeros(len(raw), np.int64)
    want, got = groups(len(x), brute_pairs(x, one, MAX_DISTANCE)), groups(len(x), zip(*forest(x, one, MAX_DISTANCE, exact=300)))
    assert len(set(want)) <= len(set(got)) <= len(set(want)) + 5
    near = as_words(clusters(2, 400, 0)[:1].repeat(400, 0))
    near[:, 1] ^= np.random.default_rng(5).integers(0, 256, 400).astype(np.uint64)
    assert len(set(groups(400, zip(*forest(near, one[:400], 9, exact=50))))) == 1


def test_hot_groups_are_cut_by_range(spark):
    """Groups that no task may hold are searched in pieces; borders of partitions lose nothing."""
    raw = clusters(3, 4000, 6)
    df = spark.createDataFrame([(bytes(r),) for r in raw], "fp binary")
    number = {bytes(r): i for i, r in enumerate(raw)}
    x = as_words(raw)
    want = len(set(groups(len(x), brute_pairs(x, np.zeros(len(x)), MAX_DISTANCE))))
    for hot in (1 << 23, 40):
        edges = [(number[bytes(r.a)], number[bytes(r.b)]) for r in near_edges(df, len(raw), hot=hot).collect()]
        assert all(np.bitwise_count(x[i] ^ x[j]).sum() <= MAX_DISTANCE for i, j in edges)
        assert want <= len(set(groups(len(x), edges))) <= want + 3


def test_no_pair_is_lost(spark):
    """Every pair at the greatest distance is linked, in one chunk and across chunks, and nothing else."""
    rng = np.random.default_rng(11)
    bits = rng.random((3000, 128)) < 0.5
    raw = np.packbits(np.concatenate([bits, bits ^ rng.permuted(np.tile(np.arange(128) < MAX_DISTANCE, (3000, 1)), axis=1)]), axis=1)
    raw = np.concatenate([raw, clusters(5, 1000, 9)])
    number = {bytes(r): i for i, r in enumerate(raw)}
    x = as_words(raw)
    want = groups(len(x), brute_pairs(x, np.zeros(len(x)), MAX_DISTANCE))
    assert all(want[i] == want[i + 3000] for i in range(3000))
    df = spark.createDataFrame([(bytes(r),) for r in raw], "fp binary")
    for hot in (1 << 23, 2500):
        edges = [(number[bytes(r.a)], number[bytes(r.b)]) for r in near_edges(df, len(raw), hot=hot).collect()]
        assert all(np.bitwise_count(x[i] ^ x[j]).sum() <= MAX_DISTANCE for i, j in edges) and groups(len(x), edges) == want
    some = [(number[bytes(r.a)], number[bytes(r.b)]) for r in near_edges(df, len(raw), recall=simhash.RECALL).collect()]
    assert len(set(groups(len(x), some)) - set(want)) < 0.1 * 3000  # the tables, on request


def test_blocks(monkeypatch):
    """Blocks cover the bits, the differences allowed leave none out; dense groups lose nothing where known links are passed over."""
    for n in (10, 5000, 10**5, 10**6):
        for most in (0, 3, 9, MAX_DISTANCE):
            blocks = simhash.blocks_for(n, most)
            assert sum(d + 1 for _, _, d in blocks) == (most + 1 if n > simhash.EXACT else 1)
            if most == MAX_DISTANCE and n > simhash.EXACT:
                assert [k for first, number, _ in blocks for k in range(first, first + number)] == list(range(128))
    raw = np.random.default_rng(7).permutation(clusters(6, 5000, 8))
    x, cut = as_words(raw), 2000
    want = groups(len(x), brute_pairs(x, np.zeros(len(x)), MAX_DISTANCE))
    monkeypatch.setattr(simhash, "PIECE", 64)
    monkeypatch.setattr(simhash, "FOUND_MOST", 500)
    whole, parted = [], []
    for block in simhash.blocks_for(len(x)):
        whole += zip(*simhash.links(x, None, block, MAX_DISTANCE))
        for shift, part in ((0, (x[:cut], None)), (cut, (x[cut:], None)), (0, (x[:cut], x[cut:]))):
            parted += [(i + shift, j + shift) for i, j in zip(*simhash.links(*part, block, MAX_DISTANCE))]
    assert groups(len(x), whole) == want == groups(len(x), parted)


def test_few_pairs_are_compared(monkeypatch):
    """The share of random pairs that meet in blocks falls as the fingerprints grow, and a dense group isn't compared with itself again and again."""
    share = {n: sum(math.comb(w, k) / 2**w for _, w, d in simhash.blocks_for(n) for k in range(d + 1)) for n in (10**5, 10**6, 10**7)}
    assert share[10**5] < 0.12 and share[10**6] < 0.035 and share[10**7] < 0.015
    bits = np.random.default_rng(8).random((20000, 128)) < 3 / 128
    x = as_words(np.unique(np.packbits(bits, axis=1), axis=0))
    compared, xor = [], np.bitwise_xor
    monkeypatch.setattr(np, "bitwise_xor", lambda a, b, out: compared.append(out.size) or xor(a, b, out=out))
    for block in simhash.blocks_for(len(x)):
        simhash.links(x, None, block, MAX_DISTANCE)
    assert sum(compared) < 0.5 * len(x) ** 2 / 2


def test_edges(spark):
    base = " ".join(f"word{i}{chr(97 + i % 26)}" for i in range(200))
    near = base.replace("word7h", "changed")
    rows = [(5, base, 1), (3, near, 1), (3, near, 1), (9, base, None), (1, None, 1), (2, None, 1), (10, "", 1), (11, "", 1), (12, "--", 1), (None, base, 1), (20, "other text " + " ".join(f"x{i}yz" for i in range(50000)), 1), (21, "a b c", 1), (22, "d e f", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, FP int")
    out = find_copies(df).collect()
    assert len(out) == len(rows)
    kept = sorted(r.doc_id for r in out if r.kept)
    assert kept == [1, 2, 3, 10, 12, 20, 21, 22]
    assert {r.group_id for r in out if r.doc_id in (None, 3, 5, 9)} == {3} and {r.n_copies for r in out if r.group_id == 3} == {5}
    left = drop_copies(df)
    assert left.schema == df.schema and sorted(r.doc_id for r in left.collect()) == kept
    assert find_copies(df.limit(0)).count() == 0 and drop_copies(df.limit(0)).count() == 0


def test_components(spark):
    n = 300
    edges = [(i, i + 1) for i in range(0, n - 1) if i % 50 != 49]
    df = spark.createDataFrame([(bytes([i // 256, i % 256]), bytes([j // 256, j % 256])) for i, j in edges], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in components(df).collect()}
    want = groups(n, edges)
    assert all(got.get(i, i) == want[i] for i in range(n))


def test_tables_hardly_grow():
    """A fixed number of tables up to four thousand million fingerprints."""
    assert len(tables_for(10)) == len(tables_for(10**6)) == len(tables_for(4 * 10**9)) <= 24
    assert len(tables_for(5 * 10**10)[0]) == 14 and len(tables_for(5 * 10**10)) < 50


def test_recall_by_distance():
    """Two fingerprints meet with the stated probability at every distance, also with the key bits of large corpora and in divided groups."""
    rng = np.random.default_rng(6)
    inside = simhash.orders(118, MAX_DISTANCE, 12, simhash.INNER_RECALL, rng)
    for count in (10**4, 10**6, 10**8, 5 * 10**10):
        samples = tables_for(count)
        for d in range(2, MAX_DISTANCE + 1, 4):
            differ = rng.permuted(np.tile(np.arange(128) < d, (4000, 1)), axis=1)
            assert np.mean(np.any([~differ[:, s].any(1) for s in samples], axis=0)) > 0.94, (count, d)  # 0.95 but for chance
            differ = rng.permuted(np.tile(np.arange(118) < d, (4000, 1)), axis=1)
            assert np.mean(np.any([~differ[:, s].any(1) for s in inside], axis=0)) > 0.97, d


def test_query(spark):
    rows = QUERIES["op6_simhash"](spark, SF).collect()
    d = pd.read_parquet(f"{SF}/documents.parquet")
    assert len(rows) == len(d)
    by_text = d.groupby("text").doc_id.apply(list)
    g = {r.doc_id: r.group_id for r in rows}
    assert all(len({g[i] for i in ids}) == 1 for ids in by_text)
