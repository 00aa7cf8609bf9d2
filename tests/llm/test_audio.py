import struct
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fathom.llm.audio import FFT, FLOOR, FRAMES, HOP, MELS, RATE, WINDOW, as_tensors, decode, features, log_mel, mel_bank, resample, segments, tensor_type
from fathom.llm.queries import QUERIES
from tests.llm.helpers import SF

HANN = np.hanning(WINDOW + 1)[:-1].astype(np.float32)


@pytest.mark.parametrize("rates", [(8000, 16000), (44100, 16000), (16000, 8000), (22050, 16000)])
def test_resampling_keeps_a_tone(rates):
    a, b = rates
    tone = lambda r: np.sin(2 * np.pi * 440 * np.arange(r) / r).astype(np.float32)
    out = resample(tone(a), a, b)
    assert len(out) == b and np.abs(out - tone(b))[200:-200].max() < 0.01
    assert len(resample(np.zeros(0, np.float32), a, b)) == 0


def test_aliases_are_removed():
    high = np.sin(2 * np.pi * 7000 * np.arange(16000) / 16000).astype(np.float32)
    assert np.abs(resample(high, 16000, 8000))[200:-200].max() < 0.1


def test_against_plain_loops():
    x = np.random.default_rng(1).normal(0, 0.2, 3000).astype(np.float32)
    mel, db = log_mel(x, mel_bank(), HANN)
    for k in range((len(x) - WINDOW) // HOP + 1):
        f = x[k * HOP : k * HOP + WINDOW].astype(float)
        f = f - f.mean()
        power = np.abs(np.fft.rfft(f * HANN, FFT)) ** 2
        assert np.allclose(mel[k], np.maximum(np.log(power @ mel_bank() + 1e-10), FLOOR), atol=1e-3)
        assert abs(db[k] - 10 * np.log10((f**2).mean() + 1e-10)) < 1e-2
    assert len(mel) == (len(x) - WINDOW) // HOP + 1


def test_segments():
    quiet, loud, middle = -80.0, -10.0, -30.0
    db = np.array([quiet] * 20 + [middle] * 5 + [loud] * 20 + [middle] * 5 + [quiet] * 30 + [middle] * 30 + [quiet] * 20 + [loud] * 12 + [quiet] * 3 + [loud] * 12 + [quiet] * 10 + [loud] * 5)
    assert segments(db) == [(20, 50), (130, 157)]
    assert segments(np.full(50, -100.0)) == [] and segments(np.empty(0)) == []


def clip(n, at, length):
    x = np.full(n, 128, np.uint8)
    x[at : at + length] = (128 + 100 * np.sin(np.arange(length) * 0.5)).astype(np.uint8)
    return x.tobytes()


def wav(data, rate, bits, channels):
    block = channels * bits // 8
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * block, block, bits)
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + fmt + b"data" + struct.pack("<I", len(data)) + data


def test_wav():
    x = np.arange(-600, 600, 2, dtype="<i2")
    got, rate = decode(wav(np.stack([x, x + 2], 1).tobytes(), 22050, 16, 2))
    assert rate == 22050 and np.allclose(got, (x + 1) / 32768)
    assert len(decode(wav(b"\x80" * 7, 8000, 8, 1))[0]) == 7 and decode(b"RIFF", 8000)[1] == 8000
    with pytest.raises(ValueError, match="PCM"):
        decode(wav(b"", 8000, 24, 1))


def test_frames(spark, tmp_path):
    rows = [(1, clip(16000, 4000, 8000), 5), (2, None, 5), (3, b"", 5), (4, b"abc", 5), (5, b"\x80" * 20000, 5), (6, clip(9000, 0, 9000), 5), (6, clip(9000, 0, 9000), 5), (None, clip(80000, 0, 80000), None), (7, wav(clip(9000, 0, 9000), 16000, 8, 1), 5)]
    df = spark.createDataFrame(rows, "clip_id long, audio binary, Segment int")
    features(df).coalesce(1).write.parquet(f"{tmp_path}/t")
    t = pq.read_table(f"{tmp_path}/t")
    assert t.column_names == ["clip_id", "segment", "part", "start_ms", "end_ms", "n_frames", "mel"]
    got = t.to_pandas()
    one = got[got.clip_id == 1]
    assert set(got.clip_id.dropna()) == {1, 2, 3, 4, 5, 6, 7} and one.start_ms.min() == pytest.approx(500, abs=40) and one.end_ms.max() == pytest.approx(1500, abs=40)
    none = got[got.segment.isna()]
    assert sorted(none.clip_id) == [2, 3, 5] and (none.n_frames == 0).all() and none.mel.isna().all()
    assert list(got[got.clip_id == 4].n_frames) == [1] and got[got.clip_id == 7].end_ms.max() < 600
    assert len(got[got.clip_id == 6]) == 2 * len(got[(got.clip_id == 6)].drop_duplicates("part"))
    long = got[got.clip_id.isna()]
    assert list(long.part) == list(range(len(long))) and long.n_frames.sum() == (160000 - WINDOW) // HOP + 1 and (long.n_frames.iloc[:-1] == FRAMES).all()
    tensors = as_tensors(t).column("mel").combine_chunks()
    assert tensors.type == tensor_type() == pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS)) and tensors.null_count == 3
    cube = tensors.drop_null().to_numpy_ndarray()
    have = got[got.n_frames > 0].reset_index(drop=True)
    assert all((pa.ipc.read_tensor(pa.BufferReader(m)).to_numpy() == c).all() for m, c in zip(have.mel, cube))
    assert all((c[n:] == np.float32(FLOOR)).all() and (c[:n] != np.float32(FLOOR)).any() for c, n in zip(cube, have.n_frames))
    assert features(df.limit(0)).count() == 0


def slow_resample(x, a, b):
    """Each output sample by itself, from the windowed sinc."""
    up, down = b // gcd(a, b), a // gcd(a, b)
    cut = min(1.0, up / down)
    half = int(np.ceil(8 / cut))
    out = []
    for n in range(-(-len(x) * up // down)):
        at = n * down / up
        base = n * down // up
        k = np.arange(base - half + 1, base + half + 1)
        t = k - at
        h = np.sinc(t * cut) * cut * np.where(np.abs(t) <= half, np.cos(np.pi * np.clip(t / (2 * half), -0.5, 0.5)) ** 2, 0)
        inside = (k >= 0) & (k < len(x))
        out.append((h * np.where(inside, x[np.clip(k, 0, len(x) - 1)], 0)).sum() / h.sum())
    return np.array(out)


def slow_features(raw):
    """(segment, part, start, frames, mel) by loops over samples, frames and energies."""
    x = slow_resample((np.frombuffer(raw, np.uint8).astype(float) - 128) / 128, 8000, RATE)
    x = np.concatenate([x, np.zeros(max(0, WINDOW - len(x)))])
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(2595 * np.log10(1 + 60 / 700), 2595 * np.log10(1 + 7600 / 700), MELS + 2)]
    f = np.arange(FFT // 2 + 1) * RATE / FFT
    bank = np.array([[max(0, min((v - lo) / (mid - lo), (hi - v) / (hi - mid))) for v in f] for lo, mid, hi in zip(edges, edges[1:], edges[2:])])
    mel, db = [], []
    for k in range(0, len(x) - WINDOW + 1, HOP):
        part = x[k : k + WINDOW] - x[k : k + WINDOW].mean()
        db.append(10 * np.log10((part**2).mean() + 1e-10))
        power = np.abs(np.fft.rfft(part * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)), FFT)) ** 2
        mel.append([max(np.log(w @ power + 1e-10), FLOOR) for w in bank])
    loud, runs, at = np.percentile(db, 95), [], None
    for k, e in enumerate([*db, -1e9]):
        if e >= loud - 25 and at is None:
            at = k
        elif e < loud - 25 and at is not None:
            if max(db[at:k]) >= loud - 15:
                if runs and at - runs[-1][1] < 5:
                    runs[-1][1] = k
                else:
                    runs.append([at, k])
            at = None
    out = []
    for s, (a, e) in enumerate(r for r in runs if loud >= -90 and r[1] - r[0] >= min(10, len(db))):
        out += [(s, p, f * 10, min(FRAMES, e - f), np.array(mel[f : min(f + FRAMES, e)])) for p, f in enumerate(range(a, e, FRAMES))]
    return out


def test_query(spark):
    """Every document has a row; those with shorter texts against plain loops that share nothing with the library."""
    got = QUERIES["op9_audio"](spark, SF).toPandas().sort_values(["doc_id", "segment", "part"])
    d = pd.read_parquet(f"{SF}/documents.parquet")
    assert set(got.doc_id) == set(d.doc_id)
    rows = {i: g for i, g in got.groupby("doc_id")}
    few = [(i, t.encode()) for i, t in zip(d.doc_id, d.text) if len(t.encode()) < 900]
    assert len(few) > 100
    for i, raw in few:
        want, mine = slow_features(raw), rows[i]
        assert [tuple(r) for r in mine[["segment", "part", "start_ms", "n_frames"]].to_numpy().tolist()] == [w[:4] for w in want], i
        for m, w in zip(mine.mel, want):
            assert np.allclose(pa.ipc.read_tensor(pa.BufferReader(m)).to_numpy()[: w[3]], w[4], atol=0.05), i
