"""SimHash near-duplicates with a Gray-order hierarchical index.

A document's fingerprint has ``BITS`` = 128 bits: for each, the sign of the
weighted sum of the hash bits of its features, which are its distinct words of any
length (``WORD_WEIGHT``) and its distinct pairs of neighbouring words
(``PAIR_WEIGHT``), so that a "not", a number and the order of words count. Copies
with a few words changed lie within ``MAX_DISTANCE`` bits, other documents near 53.

The index sorts fingerprints by Gray rank, so that neighbours share long bit
patterns. Runs of ``FANOUT`` become nodes, runs of nodes upper nodes; a node keeps
the mask of the bits on which all below it agree and their values, less what its
parent has already. A search adds up the differences on the way down and drops a
whole group as soon as the sum exceeds the distance.

At this distance an exact search of one index visits nearly every node (two
fingerprints differ in half the bits of any prefix), so fingerprints meet by blocks:
the bits are cut into blocks, fewer and wider the more fingerprints there are, and
any two within the distance are near in one of them (``blocks_for``), by the
pigeonhole principle. In a block all rows near a value are compared with all that have
it, whole groups at a time. No pair is left out; of random pairs of documents one in 45
is compared in full chunks, one in 15 among 240 000 fingerprints (measured on check_l). Fingerprints are
dealt out to chunks of up to ``CHUNK``; a task is a block of two chunks, so its memory
is bounded whatever the values; a dense group, whose rows share nearly all values, is
compared with itself only until it is known to be connected. What is shuffled is a row
of 25 bytes a fingerprint, block and chunk.

With a ``recall`` below 1, on request only, distinct fingerprints meet under top nodes
of several orders of the bits instead: a table is one order, its top nodes are the
values of its first bits (``key_bits``), and a search starts with no difference there.
It is the least probability that two fingerprints at the greatest distance meet; it
fixes the number of tables (for ``RECALL`` 20 up to ``GROUP_MOST << KEY_BITS`` = 4e9
distinct fingerprints, then slowly more; 48 at 5e10). A group of up to ``EXACT`` under
one top node is searched exactly; a larger one is divided again the same way in the
task's memory. Groups are cut by range; one cut by a border is put together again in
a second pass; one of more than ``HOT`` fingerprints is ordered anew in several
permutations, each cut by range into pieces that fit.

A search reports not all pairs but a spanning forest of them, which is all the
connected components need, so thousands of copies give thousands of edges. Components
are found by large-star/small-star rounds on tables in the shared folder; only ids and
fingerprints are shuffled.

Defined results: a null text belongs to no group and is kept; texts without words
(empty ones too) group only with equal texts; how often a word occurs doesn't count;
of a group the least id is kept (nulls last), repeated rows count as copies; ids may
be of any orderable type; extra columns, also of the names used here, pass through
``drop_copies`` and are no part of ``find_copies``; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.shared import arrow_map, quoted, written

BITS, MAX_DISTANCE, RECALL, FANOUT = 128, 22, 0.95, 8
WORD_WEIGHT, PAIR_WEIGHT = 2, 1
#: Bits of a top node at least, fingerprints under one at most on average; what is searched at once, and the aim of a division.
KEY_BITS, GROUP_MOST, EXACT, SMALL, INNER_RECALL = 10, 1 << 22, 4096, 128, 0.98
#: Fingerprints of one group that a task holds.
HOT = 1 << 23
CACHE_WORDS = 300_000
#: Fingerprints that meet in a task are this many at most of either side; rows that share a block's value on average; pairs compared at once; links kept until they are joined.
CHUNK, VALUE_ROWS, PIECE, FOUND_MOST = 1 << 20, 16, 1 << 16, 1 << 20

_WORDS = re.compile(r"\w+").findall


class _Codes(dict):
    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def word_hash(word: str) -> bytes:
    return hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=BITS // 8).digest()


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words from the words' hashes, rows of two numbers; (a, b) and (b, a) differ."""
    m = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    m ^= m >> np.uint64(31)
    m *= np.uint64(0x94D049BB133111EB)
    return m ^ (m >> np.uint64(30))


def _lanes(h: np.ndarray) -> np.ndarray:
    """Every hash's bits as 128 bytes of 0 or 1, seen as 16 numbers, so that eight counts are added at a time."""
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, BITS // 8), axis=1).view(np.uint64)


def _balance(lanes: np.ndarray) -> np.ndarray:
    """For each bit how many more rows have it than not."""
    n = len(lanes)
    return 2 * np.add.reduceat(lanes, np.arange(0, n, 255)).view(np.uint8).sum(0, dtype=np.int64) - n  # a byte holds 255


class Fingerprinter:
    """Fingerprints of texts as 16 bytes; remembers the hashes of words already met."""

    def __init__(self) -> None:
        self.codes, self.hash, self.lanes = _Codes(), np.empty((0, 2), np.uint64), np.empty((0, 16), np.uint64)

    def __call__(self, texts: list[str | None]) -> list[bytes | None]:
        if len(self.codes) > CACHE_WORDS:
            self.__init__()
        get = self.codes.__getitem__
        rows = [None if t is None else np.fromiter(map(get, _WORDS(t.lower())), np.int64) for t in texts]
        if self.codes.new:
            fresh = np.frombuffer(b"".join(map(word_hash, self.codes.new)), np.uint64).reshape(-1, 2)
            self.codes.new = []
            self.hash, self.lanes = np.concatenate([self.hash, fresh]), np.concatenate([self.lanes, _lanes(fresh)])
        return [None if r is None else self._one(r) if len(r) else word_hash(t) for t, r in zip(texts, rows)]

    def _one(self, row: np.ndarray) -> bytes:
        total = WORD_WEIGHT * _balance(self.lanes[np.unique(row)])
        if len(row) > 1:
            pair = np.unique(row[:-1] << 32 | row[1:])
            total += PAIR_WEIGHT * _balance(_lanes(pair_hashes(self.hash[pair >> 32], self.hash[pair & 0xFFFFFFFF])))
        return np.packbits(total > 0).tobytes()


# -- the index ---------------------------------------------------------------


def as_words(fp: np.ndarray) -> np.ndarray:
    """(n, 16) bytes as (n, 2) big-endian numbers."""
    return np.ascontiguousarray(fp).view(">u8").astype(np.uint64).reshape(-1, 2)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The number whose Gray code each 128-bit row is, high half first."""
    out = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    odd = (out[:, 0] & np.uint64(1)).astype(bool)
    out[odd, 1] = ~out[odd, 1]
    return out


class GrayIndex:
    """Index of fingerprints in groups; ``x`` must be sorted by group, then Gray rank."""

    def __init__(self, x: np.ndarray, group: np.ndarray):
        full = np.uint64(2**64 - 1)
        self.x, n = x, len(x)
        first = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
        self.root_of = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        # from members up: (pattern, mask of agreed bits, first child, number of children)
        pattern, mask = x, np.full_like(x, full)
        levels = [(pattern, mask, None, None)]
        owner = self.root_of
        while len(pattern) > len(starts):
            begin = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
            within = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
            head = np.flatnonzero(within % FANOUT == 0)
            ones = np.bitwise_and.reduceat(pattern, head, axis=0)
            zeros = np.bitwise_and.reduceat(~pattern, head, axis=0)
            agreed = np.bitwise_and.reduceat(mask, head, axis=0) & (ones | zeros)
            number = np.diff(np.append(head, len(owner)))
            below = levels[-1]  # children keep only what the parent lacks
            levels[-1] = (below[0], below[1] & ~np.repeat(agreed, number, axis=0), below[2], below[3])
            pattern, mask, owner = ones & agreed, agreed, owner[head]
            levels.append((pattern, mask, head, number))
        self.levels = levels[::-1]

    def pairs(self, query: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) with a smaller member of the same group within ``most`` bits; query: member numbers."""
        q, node, acc = query, self.root_of[query], np.zeros(len(query), np.int64)
        for depth, (pattern, mask, head, number) in enumerate(self.levels):
            acc = acc + np.bitwise_count((self.x[q] ^ pattern[node]) & mask[node]).sum(1, dtype=np.int64)
            near = acc <= most
            q, node, acc = q[near], node[near], acc[near]
            if depth < len(self.levels) - 1:
                k = number[node]
                end = np.cumsum(k)
                child = np.arange(end[-1] if len(end) else 0) + np.repeat(head[node] - (end - k), k)
                q, node, acc = np.repeat(q, k), child, np.repeat(acc, k)
        earlier = node < q
        return q[earlier], node[earlier]


class _Labels:
    """Components of rows; remembers an edge for every two that became one."""

    def __init__(self, n: int) -> None:
        self.of, self.left, self.right = np.arange(n), [], []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            _, first = np.unique(high, return_index=True)  # every component joins one before it
            self.left.append(a[first]), self.right.append(b[first])
            to = np.arange(len(self.of))
            to[high[first]] = low[first]
            while not np.array_equal(again := to[to], to):
                to = again
            self.of = to[self.of]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        none = [np.empty(0, np.int64)]
        return np.concatenate(self.left or none), np.concatenate(self.right or none)


def forest(x: np.ndarray, group: np.ndarray, most: int, block: int = 2_000_000, exact: int = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs within ``most`` bits in each group, as row numbers.

    Groups of up to ``exact`` rows are searched exactly, larger ones by ``_divide``.
    """
    labels = _Labels(len(x))
    _search(x, np.arange(len(x)), group, most, block, exact, labels, np.random.default_rng(64))
    return labels.edges()


def _search(x: np.ndarray, rows: np.ndarray, group: np.ndarray, most: int, block: int, exact: int, labels: _Labels, rng: np.random.Generator) -> None:
    """Joins near ones of these rows of ``x`` that share a group."""
    rank = gray_rank(x[rows])
    order = np.lexsort((rank[:, 1], rank[:, 0], group))
    rows, group = rows[order], group[order]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(rows) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(rows)))
    each = np.repeat(size, size)
    # neighbours in Gray order first: of a dense group most become one at once
    near = np.bitwise_count(x[rows[1:]] ^ x[rows[:-1]]).sum(1) <= most
    near &= group[1:] == group[:-1]
    labels.join(rows[1:][near], rows[:-1][near])
    for a in np.flatnonzero(size > exact):
        _divide(x, rows[start[a] : start[a] + size[a]], most, block, exact, labels, rng)
    few = (each > 1) & (each <= exact)
    rows, group, each = rows[few], group[few], each[few]
    index = GrayIndex(x[rows], group)
    part = np.cumsum(each) // block
    at = np.arange(len(rows))
    for cut in np.split(at, np.flatnonzero(np.diff(part)) + 1) if len(at) else []:
        a, b = index.pairs(cut, most)
        labels.join(rows[a], rows[b])


def _divide(x: np.ndarray, rows: np.ndarray, most: int, block: int, exact: int, labels: _Labels, rng: np.random.Generator) -> None:
    """A large group in orders of the bits that vary in it, so that two at the greatest distance meet with INNER_RECALL."""
    bits = np.unpackbits(x[rows].astype(">u8").view(np.uint8).reshape(-1, BITS // 8), axis=1)
    varied = np.flatnonzero(bits.any(0) & ~bits.all(0))
    most_here = min(most, len(varied))
    if len(varied) <= most:  # all are near
        labels.join(rows[1:], rows[:-1])
        return
    n = min(math.ceil(math.log2(len(rows) / SMALL)), len(varied) - most_here)
    while n > 1 and meeting(len(varied), most_here, n) < 0.02:
        n -= 1
    for s in orders(len(varied), most_here, n, INNER_RECALL, rng):
        key = bits[:, varied[s]].astype(np.int64) @ (1 << np.arange(len(s), dtype=np.int64))
        big = np.bincount(key, minlength=1)[key] > max(exact, len(rows) // 2)
        if big.any():  # not divided by this order: exactly, block by block
            _search(x, rows[big], key[big], most, block, len(rows), labels, rng)
        _search(x, rows[~big], key[~big], most, block, exact, labels, rng)


def meeting(bits: int, most: int, key_bits: int) -> float:
    """Probability that two of ``bits`` bits that differ in ``most`` agree in ``key_bits`` of them."""
    return math.comb(bits - most, key_bits) / math.comb(bits, key_bits)


def orders(bits: int, most: int, key_bits: int, recall: float, rng: np.random.Generator, inner: float = 1.0) -> list[np.ndarray]:
    """As many samples of ``key_bits`` bits as ``recall`` needs, where two that meet are found with probability ``inner``; they share bits only once all are used."""
    meet = meeting(bits, most, key_bits) * inner
    number = 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - meet))
    out, pool = [], np.empty(0, np.int64)
    for _ in range(number):
        if len(pool) < key_bits:
            pool = np.concatenate([pool, rng.permutation(bits)])
        out.append(np.unique(pool[:key_bits]))
        pool = pool[key_bits:]
    return out


# -- exact meeting -------------------------------------------------------------


def blocks_for(count: int, most: int = MAX_DISTANCE) -> list[tuple[int, int, int]]:
    """Blocks of bits (first, number, greatest difference): any two within ``most`` bits are within the last in one of them.

    The differences allowed and one more for each block add up to ``most`` and one, so two that
    exceed them in all blocks differ in more than ``most``. Few fingerprints are one block of no bits.
    """
    if count <= EXACT:
        return [(0, 0, 0)]
    number = math.ceil(BITS / min(20, math.log2(count / VALUE_ROWS)))
    cuts = [BITS * k // number for k in range(number + 1)]
    low, more = divmod(most - number + 1, number)
    wide = sorted(range(number), key=lambda k: cuts[k] - cuts[k + 1])[:more]  # the widest may differ in one more
    out = [(cuts[k], cuts[k + 1] - cuts[k], low + (k in wide)) for k in range(number)]
    return [b for b in out if b[2] >= 0]


def _block(x: np.ndarray, first: int, number: int) -> np.ndarray:
    """These bits of every row as a number."""
    if not number:
        return np.zeros(len(x), np.int64)
    shift, half = BITS - first - number, np.uint64((1 << number) - 1)
    if shift >= 64:
        return (x[:, 0] >> np.uint64(shift - 64) & half).astype(np.int64)
    low = x[:, 1] >> np.uint64(shift)
    if shift + number > 64:
        low = low | x[:, 0] << np.uint64(64 - shift)
    return (low & half).astype(np.int64)


def links(x: np.ndarray, y: np.ndarray | None, block: tuple[int, int, int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all pairs (of ``x``, or of one in ``x`` and one in ``y``) that meet in the block and are within ``most`` bits.

    Rows of ``y`` are numbered after those of ``x``. All rows whose block is near a value are compared
    with all that have the value; what is known to be connected isn't compared again where it abounds.
    """
    first, number, differ = block
    z = x if y is None else np.concatenate([x, y])
    key, rank = _block(z, first, number), gray_rank(z)
    order = np.lexsort((rank[:, 1], rank[:, 0], key))
    del rank
    labels = _Labels(len(z))
    near = np.bitwise_count(z[order[1:]] ^ z[order[:-1]]).sum(1) <= most  # neighbours in Gray order first: of a dense group most become one at once
    labels.join(order[1:][near], order[:-1][near])
    mine, theirs = (order, order) if y is None else (order[order < len(x)], order[order >= len(x)])
    a0, a1, b0, b1 = z[mine, 0], z[mine, 1], z[theirs, 0], z[theirs, 1]
    masks = np.flatnonzero(np.bitwise_count(np.arange(1 << number)) <= differ)
    begin = np.searchsorted(key[theirs], np.arange((1 << number) + 1))
    values, at = np.unique(key[mine], return_index=True)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    xor, count, more = np.empty(PIECE, np.uint64), np.empty(PIECE, np.uint8), np.empty(PIECE, np.uint8)
    for v, i, j in zip(values.tolist(), at.tolist(), [*at[1:].tolist(), len(mine)]):
        w = v ^ masks
        if y is None:
            w = w[w >= v]
        lo, n = begin[w], begin[w + 1] - begin[w]
        end = np.cumsum(n)
        if not end[-1]:
            continue
        meet, own = np.arange(end[-1]) + np.repeat(lo - (end - n), n), np.arange(i, j)
        todo = [(own, meet)]
        if len(own) * len(meet) > PIECE * 4:
            of, of_own = labels.of[theirs[meet]], labels.of[mine[own]]
            label, times = np.unique(of, return_counts=True)
            if times.max() > len(meet) // 8:
                same = label[times.argmax()]
                todo = [(own[of_own == same], meet[of != same]), (own[of_own != same], meet)]
        for own, meet in todo:
            for k in range(0, len(meet), PIECE):
                part = meet[k : k + PIECE]
                c0, c1 = b0[part], b1[part]
                step = PIECE // len(part)
                for r in range(0, len(own), step):
                    q = own[r : r + step]
                    shape, size = (len(q), len(part)), len(q) * len(part)
                    u, c, d = xor[:size].reshape(shape), count[:size].reshape(shape), more[:size].reshape(shape)
                    np.bitwise_count(np.bitwise_xor(a0[q][:, None], c0, out=u), out=c)
                    np.bitwise_count(np.bitwise_xor(a1[q][:, None], c1, out=u), out=d)
                    c += d
                    hit = np.flatnonzero(count[:size] <= most)
                    if len(hit):
                        found.append((mine[q[hit // len(part)]], theirs[part[hit % len(part)]]))
                        held += len(hit)
                        if held > FOUND_MOST:
                            labels.join(*map(np.concatenate, zip(*found)))
                            found, held = [], 0
    if found:
        labels.join(*map(np.concatenate, zip(*found)))
    return labels.edges()


# -- on Spark ---------------------------------------------------------------


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, out_col: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint (binary, null for a null text)."""

    def make():
        f = Fingerprinter()
        return lambda b: [pa.array(f(b.column(0).to_pylist()), pa.binary())]

    return arrow_map(docs, [text_col], docs.columns if keep is None else keep, [T.StructField(out_col, T.BinaryType())], make)


def tables_for(count: int, most: int = MAX_DISTANCE, recall: float = RECALL) -> list[np.ndarray]:
    """The first bits of each table's order, for so many distinct fingerprints."""
    bits = max(KEY_BITS, math.ceil(math.log2(max(count, 1) / GROUP_MOST)))
    return orders(BITS, most, bits, recall, np.random.default_rng(128), INNER_RECALL)


def _raw(fp: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(-1, BITS // 8)


_FOUND = ["a", "b", "key"]


def _near(parts: list[pa.RecordBatch], most: int, exact: int) -> pa.RecordBatch:
    """Edges of whole groups."""
    t = pa.Table.from_batches(parts)
    fp = t.column("fp").combine_chunks()
    a, b = forest(as_words(_raw(fp)), np.asarray(t.column("key")), most, exact=exact)
    return pa.RecordBatch.from_arrays([fp.take(pa.array(a)), fp.take(pa.array(b)), pa.nulls(len(a), pa.int64())], _FOUND)


def _search_sorted(most: int, exact: int, hot: int, by_range: bool):
    """From rows (key, fp) sorted by key: edges (a, b, null), and (fp, null, key) of the groups not searched.

    These are groups of more than ``hot`` rows and, with ``by_range``, the first
    and the last group of a partition, which may go on in another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []  # whole groups
        tail: list[pa.RecordBatch] = []  # the last group, unless it is passed on
        tail_key, passed = None, by_range

        def later(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column("fp"), pa.nulls(b.num_rows, pa.binary()), b.column("key")], _FOUND)

        for b in batches:
            if not b.num_rows:
                continue
            key = np.asarray(b.column("key"))
            tail_key = int(key[0]) if tail_key is None else tail_key
            n, last = (int(np.searchsorted(key, k, side)) for k, side in ((tail_key, "right"), (key[-1], "left")))
            if n:
                tail.append(b.slice(0, n))
            if n < b.num_rows:
                if passed:
                    yield from map(later, tail)
                else:
                    ready += tail
                if last > n:
                    ready.append(b.slice(n, last - n))
                tail, tail_key, passed = [b.slice(last)], int(key[-1]), False
            if passed or sum(x.num_rows for x in tail) > hot:
                yield from map(later, tail)
                tail, passed = [], True
            if sum(x.num_rows for x in ready) >= 200_000:
                yield _near(ready, most, exact)
                ready = []
        if by_range:
            yield from map(later, tail)
        else:
            ready += tail
        if ready:
            yield _near(ready, most, exact)

    return run


def _fp(x: np.ndarray) -> pa.Array:
    raw = pa.py_buffer(x.astype(">u8").tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(x), [None, raw]).cast(pa.binary())


def near_edges(distinct: DataFrame, count: int, most: int = MAX_DISTANCE, recall: float = 1.0, exact: int = EXACT, hot: int = HOT) -> DataFrame:
    """Edges (a, b) of fingerprints, column ``fp`` of ``distinct``, whose components are those of the near pairs.

    All of them; with a ``recall`` below 1 those that the tables find.
    """
    if recall < 1:
        return _table_edges(distinct, count, most, recall, exact, hot)
    chunks = max(1, math.ceil(count / min(hot, CHUNK)))
    blocks = blocks_for(math.ceil(count / chunks), most)
    number = chunks * (chunks + 1) // 2 * len(blocks)
    parts = min(number, 10_000)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every fingerprint to all pairs of chunks that its own is in, once for each block."""
        every = np.arange(chunks)
        for b in batches:
            x = as_words(_raw(b.column(0)))
            own = (pair_hashes(x[:, 0], x[:, 1]) % np.uint64(chunks)).astype(np.int64)
            for other in every:
                low, high = np.minimum(own, other), np.maximum(own, other)
                pair = (high * (high + 1) // 2 + low) * len(blocks)
                for k in range(len(blocks)):
                    yield pa.RecordBatch.from_arrays([pa.array(pair + k), pa.array(own == high), *map(pa.array, x.view(np.int64).T.copy())], ["key", "late", "hi", "lo"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, b in _by_key(batches):
            z = np.stack([np.asarray(b.column("hi")), np.asarray(b.column("lo"))], 1).view(np.uint64)
            late, pair = np.asarray(b.column("late")), key // len(blocks)
            high = (math.isqrt(8 * pair + 1) - 1) // 2
            del b
            if pair - high * (high + 1) // 2 < high:
                z = np.concatenate([z[~late], z[late]])
                a, b = links(z[: len(z) - late.sum()], z[len(z) - late.sum() :], blocks[key % len(blocks)], most)
            else:
                a, b = links(z, None, blocks[key % len(blocks)], most)
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([_fp(z[a[i : i + 100_000]]), _fp(z[b[i : i + 100_000]])], ["a", "b"])

    keyed = distinct.select("fp").mapInArrow(spread, "key long, late boolean, hi long, lo long")
    met = keyed.repartitionById(parts, F.pmod("key", F.lit(parts)).cast("int")).sortWithinPartitions("key")
    return met.mapInArrow(meet, "a binary, b binary").distinct()


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Whole groups of rows sorted by key."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        key = np.asarray(b.column("key"))
        for i, j in zip(cut := [0, *(np.flatnonzero(np.diff(key)) + 1).tolist()], [*cut[1:], len(key)]):
            if i < j:
                if key[i] != now and held:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = int(key[i])
                held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


def _table_edges(distinct: DataFrame, count: int, most: int, recall: float, exact: int, hot: int) -> DataFrame:
    """Edges found in a number of tables fixed by ``recall``: two at the greatest distance meet with that probability."""
    samples = tables_for(count, most, recall)
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = np.unpackbits(_raw(b.column(0)), axis=1).astype(np.int64)
            for t, s in enumerate(samples):
                key = (bit[:, s] @ (1 << np.arange(len(s), dtype=np.int64))) | (t << 44)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0)], ["key", "fp"])

    schema = "a binary, b binary, key long"
    keyed = distinct.select("fp").mapInArrow(spread, "key long, fp binary").repartitionByRange(parts, "key", "fp").sortWithinPartitions("key")
    first = written(keyed.mapInArrow(_search_sorted(most, exact, hot, True), schema), "near")
    edges, rest = first.filter("key IS NULL").select("a", "b"), first.filter("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    sizes = rest.groupBy("key").agg(F.count("*").alias("n"))
    large = written(sizes.filter(F.col("n") > hot), "hot-groups")
    top = large.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    if not top[0]:
        whole = rest.repartition(parts, "key").sortWithinPartitions("key")
        return edges.unionAll(whole.mapInArrow(_search_sorted(most, exact, hot, False), schema).select("a", "b")).distinct()
    mark = F.broadcast(large.select("key")) if top[0] <= 1_000_000 else large.select("key")
    whole = rest.join(mark, "key", "left_anti").repartition(parts, "key").sortWithinPartitions("key")
    edges = edges.unionAll(whole.mapInArrow(_search_sorted(most, exact, hot, False), schema).select("a", "b"))
    # hot groups: Gray order under several permutations of the bits, cut by range into pieces a task can hold
    number = len(orders(BITS, most, max(1, math.ceil(math.log2(2 * top[1] / hot))), recall, np.random.default_rng(256), INNER_RECALL))
    turns = [np.random.default_rng(512 + r).permutation(BITS) for r in range(number)]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit, key = np.unpackbits(_raw(b.column("fp")), axis=1), np.asarray(b.column("key"))
            for r, p in enumerate(turns):
                rank = gray_rank(as_words(np.packbits(bit[:, p], axis=1))).astype(">u8").tobytes()
                place = pa.array([rank[i : i + 16] for i in range(0, len(rank), 16)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key * np.int64(64) + r), place, b.column("fp")], ["key", "place", "fp"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b.select(["key", "fp"]))
            if sum(x.num_rows for x in held) >= hot:
                yield _near(held, most, exact)
                held = []
        if sum(x.num_rows for x in held):
            yield _near(held, most, exact)

    many = max(parts, math.ceil(2 * top[2] * number / hot))
    turned = rest.join(mark, "key", "left_semi").select("key", "fp").mapInArrow(turn, "key long, place binary, fp binary")
    turned = turned.repartitionByRange(many, "key", "place").sortWithinPartitions("key", "place")
    return edges.unionAll(turned.mapInArrow(pieces, schema).select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge the least node of its component, by alternating stars."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        # large star: neighbours above a node point to the least of it and its neighbours
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: neighbours below a node, and the node, point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "edges")


def _grouped(fps: DataFrame, id_col: str, most: int, recall: float) -> DataFrame:
    """``fps`` (id column, fp, others) with ``root``: the least fingerprint of the component."""
    distinct = written(fps.select("fp").filter("fp IS NOT NULL").distinct(), "distinct-fp")
    roots = components(near_edges(distinct, distinct.count(), most, recall))
    return fps.join(roots, fps["fp"] == roots["node"], "left").withColumn("__root", F.coalesce("root", "fp")).drop("node", "root")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_DISTANCE, recall: float = 1.0) -> DataFrame:
    """One row a document: id, ``fp`` (hex), ``group_id`` (least id of its group), ``n_copies`` (rows of the group), ``kept``."""
    key = F.col(quoted(id_col)).alias("__id")
    fps = written(fingerprints(docs.select(key, F.col(quoted(text_col)).alias("__text")), "__text", ["__id"]), "fingerprints")
    g = _grouped(fps, "__id", most, recall)
    known = g.filter("fp IS NOT NULL")
    # repeated ids: only the first row of the least id stays
    firsts = known.groupBy("__root", "__id", "fp").agg(F.count("*").alias("n"))
    lead = F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("fp"))).alias("lead")
    out = firsts.join(firsts.groupBy("__root").agg(F.min("__id").alias("group_id"), F.sum("n").alias("n_copies"), lead), "__root")
    is_lead = F.col("__id").eqNullSafe(F.col("lead.__id")) & (F.col("fp") == F.col("lead.fp"))
    out = out.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    out = out.select(F.col("__id").alias(id_col), F.lower(F.hex("fp")).alias("fp"), "group_id", "n_copies", (is_lead & (F.col("k") == 1)).alias("kept"))
    rest = fps.filter("fp IS NULL").select(F.col("__id").alias(id_col), F.lit(None).cast("string").alias("fp"), F.col("__id").alias("group_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("kept"))
    return out.unionAll(rest)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_DISTANCE, recall: float = 1.0) -> DataFrame:
    """``docs`` without the copies: of each group the row of the least id stays, columns as they were.

    Rows are told apart by id and a hash of the text, so what is joined to the
    texts is the list of the rows to drop; only rows that repeat id and text of a
    row that stays (if there are any) are compared as whole rows.
    """
    text = F.col(quoted(text_col))
    sign: Column = F.xxhash64(text)
    src = docs.select(F.col(quoted(id_col)).alias("__id"), text.alias("__text"), sign.alias("__sign"))
    fps = written(fingerprints(src, "__text", ["__id", "__sign"]), "fingerprints")
    g = _grouped(fps, "__id", most, recall).filter("fp IS NOT NULL")
    rows = g.groupBy("__root", "__id", "__sign").agg(F.count("*").alias("n"))
    lead = rows.groupBy("__root").agg(F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__sign"))).alias("lead"))
    marked = rows.join(lead, "__root").withColumn("stays", F.col("__id").eqNullSafe(F.col("lead.__id")) & (F.col("__sign") == F.col("lead.__sign")))
    marked = written(marked.filter("NOT stays OR n > 1").select("__id", "__sign", "stays"), "copies")
    mine = docs.withColumns({"__id": F.col(quoted(id_col)), "__sign": sign})
    same = lambda a, b: a["__id"].eqNullSafe(b["__id"]) & (a["__sign"] == b["__sign"])
    has = text.isNotNull()
    out = mine.join(marked, same(mine, marked) & has, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
    again = marked.filter("stays")
    if again.isEmpty():
        return out
    twice = mine.join(again, same(mine, again) & has, "left_semi")
    return out.unionAll(twice.dropDuplicates(["__id", "__sign"]).select(*[F.col(quoted(c)) for c in docs.columns]))
