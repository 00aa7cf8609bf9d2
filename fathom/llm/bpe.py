"""Byte-level BPE encoding and decoding on numpy matrices.

Texts are cut into pre-tokens with the public GPT-2 pattern; each distinct
pre-token of a task is encoded once. Distinct pre-tokens are bucketed by byte
length into padded id matrices; in every round each row merges its leftmost
minimum-rank pair, pair ranks come from a hashed table, finished rows leave the
matrix and the rest is compacted by one column. Decoding gathers token bytes.

Defined results: a null text gives null ids; an empty text gives an empty list.
Repeated rows each give their own result; very long texts are cut like any
other. A pre-token longer than ``LONG`` bytes would make a matrix as wide, so it is
merged by the same rule with its pairs in a heap, in time that grows with its length
times the logarithm. Output columns replace input columns of the same name, others
stay; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fathom.llm.shared import arrow_map

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cuts in the faster stdlib engine, for texts without the characters on which the two engines' classes differ.
_FAST = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: And with the classes spelt out, for texts of ASCII and Latin-1 letters alone.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^ \t\n\r0-9{_LETTER}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"
LONG = 256
NONE = np.int32(2**31 - 1)
CACHE_WORDS = 400_000


def _byte_chars() -> dict[str, int]:
    """The printable stand-in characters public byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for b, c in [*zip(plain, plain), *((b, 256 + i) for i, b in enumerate(rest))]}


class BpeVocab:
    """Merge ranks and token bytes as arrays; picklable, a few MB, so it can be broadcast."""

    def __init__(self, tokens: Sequence[bytes], pairs: np.ndarray, merged: np.ndarray):
        """tokens: bytes by id; pairs: (n, 2) ids in rank order; merged: ids they become."""
        self.tokens_len = np.array([len(t) for t in tokens], np.int32)
        self.tokens_start = np.concatenate([[0], np.cumsum(self.tokens_len, dtype=np.int64)])[:-1]
        self.tokens_flat = np.frombuffer(b"".join(tokens), np.uint8)
        single = {t[0]: i for i, t in enumerate(tokens) if len(t) == 1}
        if len(single) != 256:
            raise ValueError("the vocabulary lacks single bytes")
        self.byte_id = np.array([single[b] for b in range(256)], np.int32)
        self.merged = merged.astype(np.int32)
        self._hash(pairs[:, 0].astype(np.uint64) << np.uint64(32) | pairs[:, 1].astype(np.uint64))

    @classmethod
    def from_file(cls, path: str = DEFAULT_VOCAB) -> BpeVocab:
        """A tokenizers JSON file (explicit merges) or a tiktoken rank file (merges are recovered)."""
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            chars = _byte_chars()
            tokens = [b""] * (max(model["vocab"].values()) + 1)
            for s, i in model["vocab"].items():
                tokens[i] = bytes(chars[c] for c in s) if all(c in chars for c in s) else s.encode()
            ids = model["vocab"]
            split = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            pairs = np.array([(ids[a], ids[b]) for a, b in split], np.int64).reshape(-1, 2)
            return cls(tokens, pairs, np.array([ids[a + b] for a, b in split], np.int64))
        import base64

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        pairs, merged = [], []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = _recover(token, rank, ranks)
                if len(parts) == 2:
                    pairs.append((ranks[parts[0]], ranks[parts[1]]))
                    merged.append(rank)
        return cls(tokens, np.array(pairs, np.int64).reshape(-1, 2), np.array(merged, np.int64))

    def _hash(self, keys: np.ndarray) -> None:
        """Tables keyed by multiplicative hashes; each takes one key a slot and leaves the rest to the next."""
        self.keys = keys
        self.tables = []
        todo, ranks, rng = keys, np.arange(len(keys), dtype=np.int32), np.random.default_rng(7)
        bits = max(10, int(len(keys)).bit_length() + 1)
        while len(todo):
            mult, shift = np.uint64(int(rng.integers(1 << 62)) * 2 + 1), np.uint64(64 - bits)
            slot = (todo * mult) >> shift
            _, first = np.unique(slot, return_index=True)
            k, r = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, NONE, np.int32)
            k[slot[first]], r[slot[first]] = todo[first], ranks[first]
            self.tables.append((mult, shift, k, r))
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, ranks, bits = todo[left], ranks[left], max(8, bits - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of id pairs, NONE where there is no such merge (or an id is the padding -1)."""
        shape = a.shape
        key = ((a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)).astype(np.uint64).ravel()
        mult, shift, k, r = self.tables[0]
        slot = (key * mult) >> shift
        held = k[slot]
        out = np.where(held == key, r[slot], NONE)
        # a key sits in a later table only if another key took its slot before
        at = np.flatnonzero((held != key) & (held != np.uint64(2**64 - 1)))
        for mult, shift, k, r in self.tables[1:]:
            if not len(at):
                break
            slot = (key[at] * mult) >> shift
            hit = k[slot] == key[at]
            out[at[hit]] = r[slot[hit]]
            at = at[~hit & (k[slot] != np.uint64(2**64 - 1))]
        return out.reshape(shape)

    # -- encoding ---------------------------------------------------------

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, flat, and their number by word."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        counts, found = np.zeros(n, np.int64), []
        for i in np.flatnonzero(size > LONG):
            ids = self._long(self.byte_id[flat[start[i] : start[i] + size[i]]])
            found.append((np.array([i]), np.array([len(ids)]), ids))
        bucket = np.where(size <= 16, (size + 1) // 2 * 2, np.where(size <= 64, (size + 7) // 8 * 8, (size + 63) // 64 * 64))
        for width in np.unique(bucket[(size > 0) & (size <= LONG)]):
            rows = np.flatnonzero((bucket == width) & (size > 0) & (size <= LONG))
            step = max(1, 2_000_000 // int(width))
            for k in range(0, len(rows), step):
                found.extend(self._bucket(rows[k : k + step], start, size, flat, int(width)))
        for rows, lens, _ in found:
            counts[rows] = lens
        out = np.empty(int(counts.sum()), np.int32)
        at = np.cumsum(counts) - counts
        for rows, lens, ids in found:
            out[_ragged(at[rows], lens)] = ids
        return out, counts

    def _bucket(self, rows, start, size, flat, width):
        span = np.arange(width)
        length = size[rows]
        real = span < length[:, None]
        ids = np.where(real, self.byte_id[flat[np.minimum(start[rows][:, None] + span, len(flat) - 1)]], np.int32(-1))
        rank = np.where(real[:, 1:], self.rank(ids[:, :-1], ids[:, 1:]), NONE) if width > 1 else np.full((len(rows), 0), NONE, np.int32)
        while True:
            n, w = ids.shape
            if w < 2:
                done = np.ones(n, bool)
            else:
                every = np.arange(n)
                p = rank.argmin(1)
                best = rank[every, p]
                done = best == NONE
            if done.any():
                lens = length[done]
                yield rows[done], lens, ids[done][np.arange(w) < lens[:, None]]
                if done.all():
                    return
                go = ~done
                rows, length, ids, rank, p, best = rows[go], length[go], ids[go], rank[go], p[go], best[go]
                n, every = len(rows), np.arange(len(rows))
            # merge at p, then close the gap: every row loses exactly one column
            cols = np.arange(w - 1)
            new = self.merged[best]
            ids[every, p] = new
            ids = np.take_along_axis(ids, cols + (cols > p[:, None]), 1)
            cols = np.arange(w - 2)
            if w > 2:
                rank = np.take_along_axis(rank, cols + (cols >= p[:, None]), 1)
                at = np.flatnonzero(p > 0)
                rank[at, p[at] - 1] = self.rank(ids[at, p[at] - 1], new[at])
                at = np.flatnonzero(p < length - 2)
                rank[at, p[at]] = self.rank(new[at], ids[at, p[at] + 1])
                at = np.flatnonzero((p >= length - 2) & (p < w - 2))
                rank[at, p[at]] = NONE
            else:
                rank = rank[:, :0]
            length = length - 1

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """Leftmost pair of the least rank first, by a heap of (rank, place); places whose pair has changed are passed over."""
        n = len(ids)
        known = self.rank_of
        cur, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(ids[:-1], ids[1:])
        heap = [(r, i) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if cur[i] < 0 or j >= n or known.get((cur[i], cur[j])) != r:
                continue
            cur[i], cur[j] = int(self.merged[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := known.get((cur[i], cur[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := known.get((cur[h], cur[i]))) is not None:
                heapq.heappush(heap, (s, h))
        out = np.array(cur, np.int32)
        return out[out >= 0]

    @functools.cached_property
    def rank_of(self) -> dict[tuple[int, int], int]:
        return {(int(k >> np.uint64(32)), int(k & np.uint64(0xFFFFFFFF))): i for i, k in enumerate(self.keys)}

    # -- decoding ---------------------------------------------------------

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the number of bytes of each."""
        lens = self.tokens_len[ids]
        return self.tokens_flat[_ragged(self.tokens_start[ids], lens)], lens


def _recover(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    parts = [bytes([b]) for b in token]
    while len(parts) > 2:
        near = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank]
        if not near:
            break
        i = min(near)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of every span, one span after another."""
    lens = lens.astype(np.int64)
    end = np.cumsum(lens)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(starts - (end - lens), lens)


@functools.cache
def _odd() -> frozenset[str]:
    """Characters that the two regex engines class differently."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    odd: set[str] = set()
    for fast, exact in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")):
        odd |= set(re.findall(fast, every)) ^ set(regex.findall(exact, every))
    return frozenset(odd)


class PreTokenizer:
    """Cuts texts as PATTERN does."""

    def __init__(self) -> None:
        self.odd = _odd()
        #: Finds what isn't plainly safe, so that most texts need no look at each character.
        self.unsafe = re.compile("[^\\t\\n\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]").search
        self.plain, self.fast, self.exact = re.compile(_PLAIN).findall, re.compile(_FAST).findall, regex.compile(PATTERN).findall

    def __call__(self, text: str) -> list[str]:
        if not self.unsafe(text):
            return self.plain(text)
        return self.fast(text) if self.odd.isdisjoint(text) else self.exact(text)


class _Codes(dict):
    """Word -> running number; words met for the first time wait in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes texts; remembers up to CACHE_WORDS distinct pre-tokens, then starts afresh."""

    def __init__(self, vocab: BpeVocab) -> None:
        self.vocab, self.cut = vocab, PreTokenizer()
        self._reset()

    def _reset(self) -> None:
        self.codes, self.flat = _Codes(), np.empty(0, np.int32)
        self.start, self.len = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        if self.codes.new:
            flat, lens = self.vocab.encode_words([w.encode("utf-8", "surrogatepass") for w in self.codes.new])
            self.codes.new = []
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lens) - lens])
            self.len, self.flat = np.concatenate([self.len, lens]), np.concatenate([self.flat, flat])

    def _coded(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        if len(self.codes) > CACHE_WORDS:
            self._reset()
        get, cut = self.codes.__getitem__, self.cut
        out = [np.fromiter(map(get, cut(t)), np.int32) if t else np.empty(0, np.int32) for t in texts]
        self._learn()
        return out

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number by text (null counts as empty)."""
        coded = self._coded(texts)
        if not coded:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        every, ends = np.concatenate(coded), np.cumsum([len(c) for c in coded])
        size = self.len[every]
        counts = np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])])
        return self.flat[_ragged(self.start[every], size)], counts

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        return np.fromiter((self.len[c].sum() for c in self._coded(texts)), np.int64, len(texts))


def slices(texts: pa.Array, most: int = 8_000_000) -> Iterable[tuple[int, int]]:
    """Row ranges of at most so many characters of text (one row at least)."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
    start, held = 0, 0
    for i, s in enumerate(size):
        if held and held + s > most:
            yield start, i
            start, held = i, 0
        held += int(s)
    if start < len(size):
        yield start, len(size)


def list_array(flat: np.ndarray, counts: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    mask = None if valid is None or valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)


def encode_bpe(
    df: DataFrame, vocab: str | BpeVocab = DEFAULT_VOCAB, text_col: str = "text", keep: Sequence[str] | None = None, out_col: str = "token_ids", verify: bool = False
) -> DataFrame:
    """``keep`` columns (all, by default) with the ids in ``out_col`` and their number in ``n_tokens``.

    With ``verify`` the ids of every row are decoded again and ``round_trip``
    tells whether the bytes are those of the text (null for a null text).
    New columns replace input columns of the same name. No shuffle: one pass.
    """
    held = df.sparkSession.sparkContext.broadcast(vocab if isinstance(vocab, BpeVocab) else BpeVocab.from_file(vocab))
    fields = [T.StructField(out_col, T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())]
    if verify:
        fields.append(T.StructField("round_trip", T.BooleanType()))

    def make():
        enc = Encoder(held.value)

        def one(texts: pa.Array) -> list[pa.Array]:
            valid = np.asarray(texts.is_valid())
            values = texts.to_pylist()
            ids, counts = enc.encode(values)
            out = [list_array(ids, counts, valid), pa.array(counts.astype(np.int32), mask=~valid)]
            if verify:
                raw = b"".join(v.encode() for v in values if v)
                back, lens = enc.vocab.decode_flat(ids)
                size = np.array([len(v.encode()) if v else 0 for v in values])
                ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(counts)]
                same = len(back) == len(raw) and np.array_equal(back, np.frombuffer(raw, np.uint8)) and np.array_equal(ends, np.cumsum(size))
                if same:
                    good = np.ones(len(values), bool)
                else:  # tell the rows apart
                    begin, begun = np.concatenate([[0], ends])[:-1], np.cumsum(size) - size
                    good = np.array([back[a:b].tobytes() == raw[c : c + s] for a, b, c, s in zip(begin, ends, begun, size)])
                out.append(pa.array(good, mask=~valid))
            return out

        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            texts = b.column(0).cast(pa.string())
            parts = [one(texts.slice(i, j - i)) for i, j in slices(texts)]
            return [pa.concat_arrays(c) for c in zip(*parts)]

        return batch

    return arrow_map(df, [text_col], df.columns if keep is None else keep, fields, make)


def decode_bpe(df: DataFrame, vocab: str | BpeVocab = DEFAULT_VOCAB, ids_col: str = "token_ids", keep: Sequence[str] | None = None, out_col: str = "text") -> DataFrame:
    """The text of each row's ids: null for null, '' for an empty list.

    Bytes that are no UTF-8 (ids cut inside a character) become U+FFFD; an id
    outside the vocabulary or a null id raises an error.
    """
    held = df.sparkSession.sparkContext.broadcast(vocab if isinstance(vocab, BpeVocab) else BpeVocab.from_file(vocab))

    def make():
        v = held.value

        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            lists = b.column(0)
            valid = np.asarray(lists.is_valid())
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("a null token id can't be decoded")
            ids = np.asarray(flat, np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(v.tokens_len)):
                raise ValueError("a token id is outside the vocabulary")
            counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
            raw, lens = v.decode_flat(ids)
            ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
            buf = raw.tobytes()
            return [pa.array([buf[i:j].decode("utf-8", "replace") if ok else None for i, j, ok in zip(ends[:-1], ends[1:], valid)], pa.string())]

        return batch

    return arrow_map(df, [ids_col], df.columns if keep is None else keep, [T.StructField(out_col, T.StringType())], make)
