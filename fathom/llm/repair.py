"""Re-Pair grammar compression of token ids, in shards with random access.

A shard holds the token ids of some documents, one after another. In rounds the
pairs of neighbouring symbols are counted; frequent ones become nonterminals that
replace them (never across a document's end), until no pair occurs often enough.
A shard stores the rules (left, right), the number of tokens each expands to, the
remaining symbols and the documents' offsets in them, so any document, or any
span of one, is decoded without touching the rest.

A round takes all pairs above a bound at once and resolves overlaps from the left;
the bound falls by ``STEP`` a round, so the number of passes is near the logarithm of
the greatest count. Counting is by hashing into a table, without a sort; pairs that
lose their slot to another wait for the next round, which hashes anew. At the end the
pairs in slots that still hold enough are counted exactly, again and again, so that no
pair (of different symbols, not too long) stays that occurs ``least`` times; by default
that is where a rule, three numbers, begins to save space. After the first exact count
only places beside new symbols and those that overlaps left out are counted, for no
other pair can have become frequent.

Shards are formed in a task, of about ``SHARD_TOKENS``; there is no shuffle. A
document longer than that is a shard by itself.

Defined results: a null list is remembered as null, an empty one as empty; repeated
rows are stored as they are; ids may be any of 0 .. 2**31-1 (a shard with one of
``DENSE`` or more numbers its ids anew and keeps the list of them); of pairs that
overlap the left one is replaced, and of those of equal count the one met first
gets the lower number; columns other than the two named are no part of the shards,
whatever their names; an empty table gives no shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.bpe import DEFAULT_VOCAB, BpeVocab, Encoder, _ragged, slices
from fathom.llm.shared import quoted

SHARD_TOKENS, LEAST_COUNT, SLOT_BITS = 2_000_000, 3, 20
#: The first round takes the pairs whose count is at least this part of the greatest, every next one goes as much lower.
STEP = 3
#: For hashing pairs.
_SALTS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
#: Rules reach only expansions up to this many tokens, which bounds the depth of decoding.
LONGEST = 1 << 14
#: Ids below this are symbols themselves.
DENSE = 1 << 20


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST_COUNT) -> dict:
    """Grammar of a shard: first nonterminal, left, right, length by rule, symbols, offsets by document."""
    seq, alphabet = ids.astype(np.int32), np.empty(0, np.int32)
    if len(seq) and int(seq.max()) >= DENSE:
        alphabet, seq = np.unique(seq, return_inverse=True)
        seq = seq.astype(np.int32)
    base = first = int(seq.max()) + 1 if len(seq) else 0
    stops = np.unique(ends[ends > 0] - 1)  # symbols that end a document
    left, right, length = [np.empty(0, np.int32)], [np.empty(0, np.int32)], np.ones(first, np.int64)
    bits = max(8, min(SLOT_BITS, len(seq).bit_length() + 1))
    bound, rounds, places = 0, 0, np.empty(0, np.intp)
    while len(seq) > 1:
        slot = _slots(seq, stops, bits, rounds)
        count = np.bincount(slot, minlength=1 << bits)
        count[0] = 0
        top = int(count.max())
        if top < least:
            break  # slots hold at least what their pairs do
        if bound == least:  # all were tried once: what is left is counted exactly
            places = np.flatnonzero((count >= least).take(slot))
            break
        bound = max(least, (min(bound, top) if bound else top) // STEP)
        # slots with many pairs; the pair whose occurrence comes first there is taken if it alone is frequent
        at = np.flatnonzero((count >= bound).take(slot))
        where = slot.take(at)
        holder = np.zeros(1 << bits, np.int32)
        holder[where[::-1]] = at[::-1]
        mine = holder.take(where)
        same = (seq.take(mine) == seq.take(at)) & (seq.take(mine + 1) == seq.take(at + 1))
        at, where = at[same], where[same]
        exact = np.bincount(where, minlength=1 << bits)
        slots = np.flatnonzero(exact >= max(least, bound // 2))
        a, b = seq[holder[slots]], seq[holder[slots] + 1]
        fits = length[a] + length[b] <= LONGEST
        slots, a, b = slots[fits], a[fits], b[fits]
        number = np.full(1 << bits, -1, np.int32)
        number[slots] = np.arange(len(slots), dtype=np.int32)
        which = number[where]
        at, which = at[which >= 0], which[which >= 0]
        at, which, used = _apart(at, which, len(slots), least)
        rounds += 1
        if len(at):
            seq, stops, base, length = _replace(seq, stops, base, length, at, which, a[used], b[used], left, right)
    # ``places`` has all occurrences of every pair that occurs ``least`` times: only new symbols make new ones
    while len(places):
        at, which, a, b, others = _exact(seq, places, length, least)
        if not len(at):
            break
        seq, stops, base, length = _replace(seq, stops, base, length, at, which, a, b, left, right)
        fresh = at - np.arange(len(at))  # where the new symbols are now
        places = np.unique(np.concatenate([fresh - 1, fresh, others - np.searchsorted(at + 1, others, "right")]))
        places = places[(places >= 0) & (places < len(seq) - 1)]
        places = places[~np.isin(places, stops, assume_unique=True)]
    tokens = np.concatenate([[0], np.cumsum(length[seq])]) if len(seq) else np.zeros(1, np.int64)
    return {
        "first": first,
        "left": np.concatenate(left).astype(np.int32),
        "right": np.concatenate(right).astype(np.int32),
        "length": length[first:].astype(np.int32),
        "symbols": seq.astype(np.int32),
        "alphabet": alphabet,
        "offsets": np.searchsorted(tokens, np.concatenate([[0], ends])).astype(np.int64),
    }


def _apart(at: np.ndarray, which: np.ndarray, n_pairs: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that don't overlap, their pairs renumbered, and which pairs keep enough places to be worth a rule."""
    if not len(at):
        return at, which, np.zeros(n_pairs, bool)
    run = np.concatenate([[True], np.diff(at) > 1])  # of overlapping pairs every second goes
    if not run.all():
        n = np.arange(len(at), dtype=np.int32)
        pick = ((n - np.maximum.accumulate(np.where(run, n, 0))) & 1) == 0
        at, which = at[pick], which[pick]
    used = np.bincount(which, minlength=n_pairs) >= min(least, 3)
    renumber = (np.cumsum(used) - 1).astype(np.int32)
    good = used[which]
    return at[good], renumber[which[good]], used


def _slots(seq: np.ndarray, stops: np.ndarray, bits: int, turn: int) -> np.ndarray:
    """The hash of every pair of neighbours, another one each turn; pairs across a document's end are in slot 0."""
    u = seq.view(np.uint32)
    slot = u[:-1] * np.uint32(_SALTS[turn % len(_SALTS)])
    slot += u[1:] * np.uint32(_SALTS[turn % len(_SALTS) - 1])
    slot >>= np.uint32(32 - bits)
    slot = np.maximum(slot, 1).astype(np.intp)
    slot[stops[stops < len(slot)]] = 0
    return slot


def _exact(seq: np.ndarray, at: np.ndarray, length: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs at these places those that occur ``least`` times: places, pair by place, lefts and rights; and the places of such pairs that overlaps left out."""
    pair, which, count = np.unique((seq[at].astype(np.int64) << 32) | seq[at + 1], return_inverse=True, return_counts=True)
    a, b = pair >> 32, pair & 0xFFFFFFFF
    wanted = (count >= least) & (length[a] + length[b] <= LONGEST)
    for few in (wanted, None):
        if few is None:  # overlaps left none: of pairs that overlap only the more frequent, so the most frequent of all stays whole
            few = wanted & (a != b)
            own = which[few[which]]
            order = np.lexsort((-np.arange(len(pair)), count))
            place = np.empty(len(pair), np.int64)
            place[order] = np.arange(len(pair))
            beside = np.flatnonzero(np.diff(at[few[which]]) == 1)
            x, y = own[beside], own[beside + 1]
            few[np.where(place[x] < place[y], x, y)] = False
        keep = few[which]
        where, number, used = _apart(at[keep], (np.cumsum(few) - 1).astype(np.int32)[which[keep]], int(few.sum()), least)
        if len(where):
            break
    return where, number, a[few][used].astype(np.int32), b[few][used].astype(np.int32), np.setdiff1d(at[wanted[which]], where, assume_unique=True)


def _replace(seq, stops, base, length, at, which, a, b, left, right) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """The shard after the pairs (a, b) at these places became nonterminals, which are added to the rules."""
    left.append(a), right.append(b)
    seq[at] = base + which
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return seq[keep], stops - np.searchsorted(at + 1, stops, "right"), base + len(a), np.concatenate([length, length[a] + length[b]])


def expand(symbols: np.ndarray, g: dict) -> np.ndarray:
    """The tokens of the symbols: the rules that occur are opened level by level, then all symbols looked up."""
    out = _expand(symbols, g["first"], np.asarray(g["left"]), np.asarray(g["right"]))
    return np.asarray(g["alphabet"], np.int32)[out] if len(g["alphabet"]) else out


def _expand(symbols: np.ndarray, first: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    seq = np.asarray(symbols, np.int32)
    if len(seq) > 4 * len(left):
        rules = _open(np.arange(first, first + len(left)), first, left, right)
        size = np.concatenate([np.ones(first, np.int64), _lengths(first, left, right)])
        flat = np.concatenate([np.arange(first, dtype=np.int32), rules])
        return flat[_ragged((np.cumsum(size) - size)[seq], size[seq])]
    return _open(seq, first, left, right)


def _lengths(first: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Tokens of every rule; a rule uses only symbols before it."""
    out = [1] * first
    for a, b in zip(left.tolist(), right.tolist()):
        out.append(out[a] + out[b])
    return np.array(out[first:], np.int64)


def _open(seq: np.ndarray, first: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    seq = np.asarray(seq, np.int64)
    while True:
        deep = seq >= first
        if not deep.any():
            return seq.astype(np.int32)
        at = np.cumsum(1 + deep) - 1 - deep
        out = np.empty(len(seq) + int(deep.sum()), np.int64)
        out[at] = seq
        out[at[deep]] = left[seq[deep] - first]
        out[at[deep] + 1] = right[seq[deep] - first]
        seq = out


def decode_span(shard: dict, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Tokens start..stop of the shard's document number ``doc``; only symbols that overlap the span are opened."""
    first, off = shard["first"], shard["offsets"]
    symbols = np.asarray(shard["symbols"][off[doc] : off[doc + 1]], np.int64)
    length = np.where(symbols >= first, np.asarray(shard["length"], np.int64)[np.maximum(symbols - first, 0)] if len(shard["length"]) else 1, 1)
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.empty(0, np.int32)
    a, b = int(np.searchsorted(end, start, "right")), int(np.searchsorted(end, stop, "left"))
    got = expand(symbols[a : b + 1], shard)
    skip = start - int(end[a] - length[a])
    return got[skip : skip + stop - start]


# -- on Spark ---------------------------------------------------------------

_BINARY = {"left": "rule_left", "right": "rule_right", "length": "rule_length", "symbols": "symbols", "alphabet": "alphabet"}
#: Numbers packed at a time, a multiple of 8 so that parts end with a byte.
_PACK = 1 << 16


def pack_ints(x: np.ndarray) -> bytes:
    """Integers of the least number of bits, high bit first; the first byte tells it, the second the unused bits at the end."""
    width = max(1, int(x.max()).bit_length()) if len(x) else 1
    parts = [np.packbits(np.unpackbits(np.ascontiguousarray(x[i : i + _PACK], ">i4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]).tobytes() for i in range(0, len(x), _PACK)]
    return bytes([width, -len(x) * width % 8]) + b"".join(parts)


def unpack_ints(raw: bytes) -> np.ndarray:
    width, unused = raw[0], raw[1]
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=2))
    out = np.zeros(((len(bits) - unused) // width, 32), np.uint8)
    out[:, 32 - width :] = bits[: len(bits) - unused].reshape(-1, width)
    return np.packbits(out, axis=1).view(">i4").ravel().astype(np.int32)


def shard_of(row) -> dict:
    """What decode_span takes, of a row of ``compress_ids`` or ``compress_texts``."""
    return {"first": row["first_rule"], "offsets": np.array(row["offsets"], np.int64)} | {k: unpack_ints(bytes(row[c])) for k, c in _BINARY.items()}


def _schema(kind: T.DataType, id_col: str) -> T.StructType:
    names = [("n_docs", T.LongType()), ("n_tokens", T.LongType()), ("n_symbols", T.LongType()), ("n_rules", T.LongType()), ("first_rule", T.IntegerType())]
    return T.StructType([
        T.StructField(f"{id_col}s", T.ArrayType(kind)), T.StructField("nulls", T.ArrayType(T.IntegerType())), *(T.StructField(n, t) for n, t in names),
        *(T.StructField(c, T.BinaryType()) for c in _BINARY.values()), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("intact", T.BooleanType()),
    ])


def _shards(batches: Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]], schema: T.StructType, most: int, least: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """From (ids, valid, flat tokens, counts) to one row a shard."""
    names = schema.fieldNames()

    def row(ids: list[pa.Array], valid: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        g = compress(flat, np.cumsum(counts), least)
        same = bool(np.array_equal(expand(g["symbols"], g), flat))
        values = [[pa.concat_arrays(ids).to_pylist()], [np.flatnonzero(~valid).tolist()], [len(counts)], [len(flat)], [len(g["symbols"])], [len(g["left"])], [g["first"]], *([pack_ints(g[k])] for k in _BINARY), [g["offsets"].tolist()], [same]]
        types = [pa.list_(id_type), pa.list_(pa.int32()), *[pa.int64()] * 4, pa.int32(), *[pa.binary()] * len(_BINARY), pa.list_(pa.int64()), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

    held: list[tuple] = []
    size = 0
    for ids, valid, flat, counts in batches:
        end, at = np.cumsum(counts), 0
        while at < len(counts):
            before = int(end[at - 1]) if at else 0
            take = max(int(np.searchsorted(end, before + most - size, "right")), at + (not size))
            if take > at:
                stop = int(end[take - 1])
                held.append((ids.slice(at, take - at), valid[at:take], flat[before:stop], counts[at:take]))
                size, at = size + stop - before, take
            if at < len(counts):
                yield row([h[0] for h in held], *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3)))
                held, size = [], 0
    if held:
        yield row([h[0] for h in held], *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3)))


def compress_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", shard_tokens: int = SHARD_TOKENS, least: int = LEAST_COUNT) -> DataFrame:
    """One row a shard; see ``shard_of`` and ``decode_span`` for reading it."""
    src = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(ids_col)).cast("array<int>").alias("x"))
    schema = _schema(src.schema["id"].dataType, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            nonlocal kind
            for b in batches:
                kind, lists = b.column(0).type, b.column(1)
                flat = lists.flatten()
                if flat.null_count or (len(flat) and pa.compute.min(flat).as_py() < 0):
                    raise ValueError("token ids must be non-negative")
                yield b.column(0), np.asarray(lists.is_valid()), np.asarray(flat), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)

        kind = None
        source = parts()
        first = next(source, None)
        if first is not None:
            import itertools

            yield from _shards(itertools.chain([first], source), schema, shard_tokens, least, first[0].type)

    return src.mapInArrow(run, schema)


def compress_texts(docs: DataFrame, vocab: str = DEFAULT_VOCAB, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, least: int = LEAST_COUNT) -> DataFrame:
    """As ``compress_ids`` on the BPE ids of the texts, which are never written out."""
    held = docs.sparkSession.sparkContext.broadcast(BpeVocab.from_file(vocab))
    src = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("x"))
    schema = _schema(src.schema["id"].dataType, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        enc = Encoder(held.value)

        def parts():
            for b in batches:
                texts = b.column(1).cast(pa.string())
                for i, j in slices(texts):
                    part = texts.slice(i, j - i)
                    flat, counts = enc.encode(part.to_pylist())
                    yield b.column(0).slice(i, j - i), np.asarray(part.is_valid()), flat, counts

        source = parts()
        first = next(source, None)
        if first is not None:
            yield from _shards(itertools.chain([first], source), schema, shard_tokens, least, first[0].type)

    return src.mapInArrow(run, schema)


def decompress(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, token_ids) of every document of the shards, nulls as they were."""
    kind = shards.schema[f"{id_col}s"].dataType.elementType
    cols = [f"{id_col}s", "nulls", "first_rule", *_BINARY.values(), "offsets"]
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(i)[k].as_py() for i, c in enumerate(b.schema.names)}
                g, none = shard_of(row), set(row["nulls"])
                docs = [None if d in none else decode_span(g, d) for d in range(len(row[cols[0]]))]
                yield pa.RecordBatch.from_arrays([pa.array(row[cols[0]], b.schema.field(0).type.value_type), pa.array(docs, pa.list_(pa.int32()))], schema.fieldNames())

    return shards.select(*cols).mapInArrow(run, schema)
