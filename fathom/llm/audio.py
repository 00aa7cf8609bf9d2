"""Audio features: polyphase resampling, log-mel filterbanks, energy segmentation.

A clip is raw unsigned 8-bit or signed 16-bit PCM, or a WAV file of either, whose
header then tells its rate, width and channels (which are averaged). It is resampled
by a polyphase filter (windowed sinc, one bank of taps for each phase, so that no
sample is computed that isn't kept), cut into overlapping Hann frames, and turned
into log-mel energies. Speech-like segments come from the frames' energy by
hysteresis: a segment starts above the upper threshold, lasts while the energy
stays above the lower one, and must have a least length. A segment is stored as
tensors of the fixed shape (FRAMES, MELS), the last one padded with the floor, each
with its time span. A tensor is an Arrow tensor message, float32, so that every row
tells its own shape; ``as_tensors`` makes a whole column a fixed-shape tensor array.

Thresholds are relative to the clip's own 95th percentile of frame energy, so the
gain of a recording doesn't matter. Everything is done in float32 numpy, block by
block, so a clip's memory stays bounded by its samples.

Defined results: every clip has a row. One without a segment (null or empty bytes,
constant silence) has a single row with null segment, span and tensor and
``n_frames`` 0; a clip shorter than a frame is padded with silence to one, and one
of fewer frames than the least of a segment can be one as a whole; an odd last byte
of 16-bit data is dropped; repeated rows each give their rows; kept columns named as
those of FIELDS are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.shared import others, quoted, unused

RATE_IN, RATE = 8000, 16000
WINDOW, HOP, FFT, MELS, FRAMES = 400, 160, 512, 40, 96
LOW_HZ, HIGH_HZ, FLOOR = 60.0, 7600.0, -23.0
#: Decibels below the clip's loud level at which a segment starts and ends, and the least frames of one and of a gap.
UPPER_DB, LOWER_DB, LEAST_FRAMES, LEAST_GAP = 15.0, 25.0, 10, 5
TAPS = 16
_BLOCK = 4096


#: What precedes the values of a tensor of the fixed shape, of FRAMES * MELS float32.
def _prefix() -> bytes:
    out = pa.BufferOutputStream()
    pa.ipc.write_tensor(pa.Tensor.from_numpy(np.zeros((FRAMES, MELS), np.float32)), out)
    raw = out.getvalue().to_pybytes()
    return raw[: len(raw) - FRAMES * MELS * 4]


PREFIX = _prefix()


def decode(raw: bytes, rate: int = 8000, bits: int = 8) -> tuple[np.ndarray, int]:
    """Samples and rate of a WAV file, or of raw PCM of the given form."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return samples(raw, bits), rate
    at, channels, data = 12, 1, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        if name == b"fmt " and size >= 16:
            channels, rate, bits = (int.from_bytes(raw[at + k : at + k + n], "little") for k, n in ((10, 2), (12, 4), (22, 2)))
            if int.from_bytes(raw[at + 8 : at + 10], "little") not in (1, 0xFFFE) or bits not in (8, 16) or not channels or not rate:
                raise ValueError("only 8- and 16-bit PCM is read")
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    x = samples(data, bits)
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1) if channels > 1 else x, rate


def samples(raw: bytes, bits: int = 8) -> np.ndarray:
    """Samples in -1..1."""
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    return np.frombuffer(raw, "<i2", len(raw) // 2).astype(np.float32) / 32768


def phase_bank(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """(up, taps * spread) filter: row p makes the outputs that lie p / up after an input sample."""
    cut = min(1.0, up / down)
    half = int(np.ceil(taps / 2 / cut))
    t = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    h = np.sinc(t * cut) * cut * np.where(np.abs(t) <= half, np.cos(np.pi * np.clip(t / (2 * half), -0.5, 0.5)) ** 2, 0)
    return (h / h.sum(1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    """Polyphase: output n lies at input position n * down / up."""
    if rate_in == rate_out or not len(x):
        return x
    g = gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g
    bank = phase_bank(up, down)
    half = bank.shape[1] // 2
    n = (len(x) * up + down - 1) // down
    padded = np.concatenate([np.zeros(half - 1, np.float32), x, np.zeros(half + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    out = np.empty(n, np.float32)
    for p in range(up):  # outputs p, p + up, ... share a phase and advance by `down` inputs
        where, phase = divmod(p * down, up)
        k = len(range(p, n, up))
        if k:
            out[p::up] = windows[where : where + (k - 1) * down + 1 : down] @ bank[phase]
    return out


def mel_bank(rate: int = RATE, fft: int = FFT, mels: int = MELS, low: float = LOW_HZ, high: float = HIGH_HZ) -> np.ndarray:
    """(fft // 2 + 1, mels) triangles, equally spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(mel(low), mel(min(high, rate / 2)), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(fft, 1 / rate)[:, None]
    rise, fall = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, bank: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) natural logs of mel energies, and the frames' energies in dB."""
    if not len(x):
        return np.empty((0, MELS), np.float32), np.empty(0, np.float32)
    if len(x) < WINDOW:
        x = np.concatenate([x, np.zeros(WINDOW - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    out, db = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for k in range(0, len(frames), _BLOCK):
        part = frames[k : k + _BLOCK]
        part = part - part.mean(1, keepdims=True)
        db[k : k + len(part)] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / WINDOW + 1e-10)
        spectrum = np.fft.rfft(part * window, FFT)
        power = spectrum.real**2 + spectrum.imag**2
        out[k : k + len(part)] = np.maximum(np.log(power.astype(np.float32) @ bank + 1e-10), FLOOR)
    return out, db


def segments(db: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges by hysteresis."""
    if not len(db):
        return []
    loud = float(np.percentile(db, 95))
    if loud < -90:
        return []
    low, high = db >= loud - LOWER_DB, db >= loud - UPPER_DB
    change = np.flatnonzero(np.diff(np.concatenate([[0], low.astype(np.int8), [0]])))
    runs = [(int(a), int(b)) for a, b in zip(change[::2], change[1::2]) if high[a:b].any()]
    joined: list[tuple[int, int]] = []
    for a, b in runs:
        if joined and a - joined[-1][1] < LEAST_GAP:
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    return [(a, b) for a, b in joined if b - a >= min(LEAST_FRAMES, len(db))]


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))


def as_tensors(table: pa.Table, column: str = "mel") -> pa.Table:
    """``table`` with the tensor messages as one Arrow fixed-shape tensor array (null where there is none)."""
    col = table.column(column).combine_chunks()
    have = np.asarray(col.is_valid())
    raw = np.frombuffer(b"".join(col.drop_null().to_pylist()), np.uint8).reshape(-1, len(PREFIX) + FRAMES * MELS * 4)
    if (raw[:, : len(PREFIX)] != np.frombuffer(PREFIX, np.uint8)).any():
        raise ValueError("a tensor of another shape")
    values = np.zeros((len(col), FRAMES * MELS), np.float32)
    values[have] = np.ascontiguousarray(raw[:, len(PREFIX) :]).view(np.float32)
    fixed = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FRAMES * MELS, mask=pa.array(~have))
    return table.set_column(table.schema.get_field_index(column), column, pa.ExtensionArray.from_storage(tensor_type(), fixed))


FIELDS = (("segment", "int"), ("part", "int"), ("start_ms", "long"), ("end_ms", "long"), ("n_frames", "int"), ("mel", "binary"))


def features(clips: DataFrame, audio_col: str = "audio", keep: Sequence[str] | None = None, rate_in: int = RATE_IN, bits: int = 8) -> DataFrame:
    """One row a tensor: ``keep`` columns (all but the audio by default; those that clash with FIELDS are left out), then FIELDS.

    ``segment`` and ``part`` count from 0; ``start_ms``..``end_ms`` is the span of
    the part's ``n_frames`` real frames; ``mel`` is a tensor of FRAMES x MELS.
    ``rate_in`` and ``bits`` hold for clips without a header.
    """
    keep = others([c for c in (clips.columns if keep is None else keep) if c != audio_col], [n for n, _ in FIELDS])
    src = clips.select(F.col(quoted(audio_col)).cast("binary").alias(unused(keep, "__audio")), *[F.col(quoted(c)) for c in keep])
    made = clips.sparkSession.createDataFrame([], ", ".join(f"{n} {t}" for n, t in FIELDS)).schema
    schema = T.StructType([*(src.schema[c] for c in keep), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank, window = mel_bank(), np.hanning(WINDOW + 1)[:-1].astype(np.float32)
        kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.int32(), pa.binary()]
        for b in batches:
            rows: list[tuple] = []

            def full() -> pa.RecordBatch:
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([*(c.take(cols[0]) for c in b.columns[1:]), *cols[1:]], schema.fieldNames())

            for i in range(b.num_rows):
                raw = b.column(0)[i].as_py()
                found = 0
                if raw:
                    x, rate = decode(raw, rate_in, bits)
                    mel, db = log_mel(resample(x, rate, RATE), bank, window)
                    for s, (a, e) in enumerate(segments(db)):
                        found += 1
                        for p, f in enumerate(range(a, e, FRAMES)):
                            part = mel[f : min(f + FRAMES, e)]
                            n = len(part)
                            if n < FRAMES:
                                part = np.concatenate([part, np.full((FRAMES - n, MELS), FLOOR, np.float32)])
                            rows.append((i, s, p, f * HOP * 1000 // RATE, ((f + n - 1) * HOP + WINDOW) * 1000 // RATE, n, PREFIX + part.tobytes()))
                            if len(rows) >= 512:
                                yield full()
                                rows = []
                if not found:
                    rows.append((i, None, None, None, None, 0, None))
            if rows:
                yield full()

    return src.mapInArrow(run, schema)
