"""Bounded-space online packing of token sequences into fixed windows.

Every partition keeps at most ``OPEN`` windows open. A piece goes to the open
window it fits best (least room left); when it fits none and all slots are
taken, the fullest open window is emitted and a new one opened. At the end of a
partition the windows still open are leftovers; the leftovers of all partitions
are merged in a second phase by best fit, largest first, on their fills alone.

Documents longer than a window are cut into full windows (emitted at once) and
a rest, so every token of every document is packed exactly once. The pieces of
open windows wait in the task (there are at most OPEN * capacity of them), so
those of leftovers are known by themselves: only they meet the merged windows.

Defined results: a null or non-positive length has no tokens and gives no row;
a document of exactly the capacity fills one window; repeated rows are packed
as separate pieces, told apart by ``row_id``; ties between windows go to the one
opened first; an id column named as one of RESULT comes out with ``_in`` behind its
name, other columns are no part of the result; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.bpe import DEFAULT_VOCAB, BpeVocab, Encoder, list_array, slices
from fathom.llm.shared import arrow_map, others, quoted, written
from pyspark.sql import types as T

CAPACITY = 2048
OPEN = 64
#: Leftover windows merged in one task; there are at most OPEN from a partition. All are merged, in as many tasks as it takes.
GROUP = 200_000
#: Characters encoded at once, and tokens of pieces written at once, which bound a worker's memory.
TEXT_MOST, TOKENS_MOST = 1_000_000, 1_000_000

RESULT = ("row_id", "window_id", "window_offset", "doc_start", "n_tokens", "token_ids")


class Packer:
    """Best-fit with at most ``most`` open windows; ``emit(window)`` is called once for each closed one."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.open: list[tuple[int, int]] = []  # (room, number), least room first
        self.made = 0

    def place(self, size: int) -> tuple[int, int, int | None]:
        """Window and offset for a piece, and the number of the window emitted to make place."""
        closed = None
        i = bisect_left(self.open, (size, -1))
        if i < len(self.open):
            room, number = self.open.pop(i)
        else:
            if len(self.open) >= self.most:
                closed = self.open.pop(0)[1]
            room, number = self.capacity, self.made
            self.made += 1
        if room > size:
            insort(self.open, (room - size, number))
        return number, self.capacity - room, closed


def token_lengths(docs: DataFrame, vocab: str = DEFAULT_VOCAB, text_col: str = "text", keep: Sequence[str] | None = None, out_col: str = "n_tokens") -> DataFrame:
    """BPE token counts of the texts (null for null) without building the ids."""
    held = docs.sparkSession.sparkContext.broadcast(BpeVocab.from_file(vocab))

    def make():
        enc = Encoder(held.value)

        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            texts = b.column(0).cast(pa.string())
            n = [enc.count(texts.slice(i, j - i).to_pylist()) for i, j in slices(texts)]
            return [pa.array(np.concatenate(n).astype(np.int32), mask=~np.asarray(texts.is_valid()))]

        return batch

    return arrow_map(docs, [text_col], docs.columns if keep is None else keep, [T.StructField(out_col, T.IntegerType())], make)


def pack(docs: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", ids_col: str | None = None, capacity: int = CAPACITY, most_open: int = OPEN, group: int = GROUP, text_col: str | None = None, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """Pieces: ``id_col``, row_id (of the input row), window_id, window_offset (in the window), doc_start (in the document), n_tokens.

    With ``ids_col`` the lengths are those of its lists and every piece has its
    ``token_ids``; with ``text_col`` the lists are the BPE ids of its texts, made in the
    same worker, a few texts at a time, so that they are never held as a column. The
    pieces are written once to the shared folder, for the second phase must see the
    windows the first has made; it moves the fills of leftover windows (OPEN a
    partition), in groups of ``group``.
    """
    if capacity < 1 or most_open < 1:
        raise ValueError("capacity and most_open must be positive")
    if text_col:
        ids_col, size, held = "token_ids", F.col(quoted(text_col)), docs.sparkSession.sparkContext.broadcast(BpeVocab.from_file(vocab))
    else:
        size, held = F.col(quoted(ids_col)).cast("array<int>") if ids_col else F.col(quoted(length_col)).cast("long"), None
    src = docs.select(F.col(quoted(id_col)).alias("id"), size.alias("n"))
    kind = src.schema["id"].dataType
    names = ["id", "row", "win", "at", "doc_start", "n", *(["token_ids"] if ids_col else []), "left"]
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in names[1:6]), *([T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if ids_col else []), T.StructField("left", T.BooleanType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list, np.ndarray | None]]:
        """Ids, their lengths and their tokens, one after another."""
        enc = Encoder(held.value) if held else None
        for b in batches:
            keys, lists = b.column(0), b.column(1)
            if enc:
                texts = lists.cast(pa.string())
                for i, j in slices(texts, TEXT_MOST):
                    flat, sizes = enc.encode(texts.slice(i, j - i).to_pylist())
                    yield keys.slice(i, j - i), sizes.tolist(), flat
            elif ids_col:
                yield keys, pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_pylist(), np.asarray(lists.flatten(), np.int32)
            else:
                yield keys, lists.to_pylist(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, base = Packer(capacity, most_open), part << 33
        full = 1 << 32  # numbers of windows that one long document fills alone
        row, done, waiting, kind, none = part << 40, [], {}, None, np.empty(0, np.int32)

        def batch(pieces: list[tuple], left: bool) -> pa.RecordBatch:
            cols = list(zip(*pieces)) or [()] * 7
            made = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:6])]
            if ids_col:
                tokens = [none if t is None else t for t in cols[6]]
                made.append(list_array(np.concatenate([none, *tokens]), np.fromiter(map(len, tokens), np.int64, len(tokens))))
            return pa.RecordBatch.from_arrays([*made, pa.array([left] * len(pieces), pa.bool_())], names)

        for ids, sizes, flat in read(batches):
            kind, keys = ids.type, ids.to_pylist()
            begin = (np.cumsum(sizes) - sizes).tolist() if ids_col else []
            for i, n in enumerate(sizes):
                row += 1
                if not n or n < 0:
                    continue
                cut = (lambda a, e, o=begin[i]: flat[o + a : o + e].copy()) if ids_col else lambda a, e: None
                start = 0
                while n - start >= capacity:
                    done.append((keys[i], row, base + full, 0, start, capacity, cut(start, start + capacity)))
                    full, start = full + 1, start + capacity
                if n > start:
                    number, offset, closed = packer.place(n - start)
                    waiting.setdefault(number, []).append((keys[i], row, base + number, offset, start, n - start, cut(start, n)))
                    if closed is not None:
                        done += waiting.pop(closed)
                    if offset + n - start == capacity:
                        done += waiting.pop(number)
                if len(done) >= 2000 or ids_col and len(done) * capacity > TOKENS_MOST:
                    yield batch(done, False)
                    done = []
        if done:
            yield batch(done, False)
        if waiting:
            yield batch([p for w in waiting.values() for p in w], True)
            # marks: the fills of the windows still open
            yield batch([(None, None, base + number, -1, None, capacity - room, None) for room, number in packer.open], True)

    pieces = written(src.mapInArrow(run, schema), "packed")
    marks = pieces.filter("at < 0").select("win", F.col("n").alias("fill"))
    left = pieces.filter("at >= 0 AND left")
    groups = max(1, -(-marks.count() // group))

    def merge(_, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "win"], ascending=[False, True])
        packer, into, shift, first = Packer(capacity, len(pdf) + 1), [], [], {}
        for win, fill in zip(pdf["win"], pdf["fill"]):
            number, offset, _ = packer.place(int(fill))
            into.append(first.setdefault(number, win))
            shift.append(offset)
        return pd.DataFrame({"win": pdf["win"], "into": into, "shift": shift})

    mapping = marks.groupBy(F.pmod(F.hash("win"), F.lit(groups)).alias("g")).applyInPandas(merge, "win long, into long, shift long")
    moved = left.join(mapping, "win").withColumns({"win": F.col("into"), "at": F.col("at") + F.col("shift")})
    out = pieces.filter("NOT left").unionByName(moved.select(*pieces.columns))
    return out.select(
        F.col("id").alias(id_col if others([id_col], RESULT) else f"{id_col}_in"),
        F.col("row").alias("row_id"),
        F.col("win").alias("window_id"),
        F.col("at").cast("int").alias("window_offset"),
        F.col("doc_start").cast("int").alias("doc_start"),
        F.col("n").cast("int").alias("n_tokens"),
        *(["token_ids"] if ids_col else []),
    )
