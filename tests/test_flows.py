"""Decisions, chunks and intervals against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import chunks, decisions, intervals


def test_decisions_follow_each_other(spark):
    """A hot stream, small ones and a null one; the loop takes one frame after the other."""
    r = random.Random(1)
    rows = []
    for s, n in ((0, 900), (None, 40), *((s, r.randint(1, 30)) for s in range(1, 40))):
        rows += [(s, q, r.randrange(5000, 70_000), r.randrange(128), r.choice([0.0, 0.3, 1.0]), r.random() < 0.4, r.randrange(40), r.random() < 0.2, r.randrange(1, 60), r.choice([120, 480, 960, 2880]), r.randrange(5)) for q in range(n)]
    names = "stream_id long, seq long, rate int, voice int, width double, fec boolean, loss int, dtx boolean, max_bytes int, samples int, bandwidth int"
    df = spark.createDataFrame(rows, names).repartition(5)
    got = {(x.stream_id, x.seq): (x.mode, x.copy, x.sent_bandwidth) for x in decisions.decide_copies(decisions.decide_modes(df)).collect()}
    assert len(got) == len(rows)
    state = {}
    for s, q, rate, voice, width, fec, loss, dtx, most, samples, bandwidth in rows:
        mode, copy = state.get(s, ("none", False))
        level = 10_000 + voice * voice * (int((1 - width) * 64_000 + width * 44_000 + 0.5) - 10_000) // 16_384 + {"none": 0, "silk": 4000, "celt": -4000}[mode]
        mode = "celt" if rate >= level else "silk"
        if (fec and loss > (128 - voice) // 16) or (dtx and voice > 100):
            mode = "silk"
        if most < (9000 if 48_000 // samples > 50 else 6000) * 6 // (6 * 48_000 // samples) // 8 or samples < 480:
            mode = "celt"
        sent, found = bandwidth, False
        if fec and loss and mode == "silk":
            for b in range(bandwidth, -1, -1):
                if rate > ((12_000, 14_000, 16_000, 20_000, 22_000)[b] + (-1000 if copy else 1000)) * (125 - min(loss, 25)) // 100:
                    sent, found = b, True
                    break
                if loss <= 5:
                    break
        state[s] = (mode, found)
        assert got[s, q] == (mode, found, sent)
    assert {m for m, *_ in got.values()} == {"silk", "celt"} and any(c and b != w[10] for w in rows for _, c, b in [got[w[0], w[1]]])


def test_any_chunks_give_the_same_frames(spark):
    r = random.Random(2)
    whole = {s: [float(i) for i in range(n)] for s, n in ((0, 1000), (None, 7), (2, 30), (3, 0))}
    for _ in range(2):
        rows = []
        for s, x in whole.items():
            at, seq = 0, 0
            while at < len(x) or not seq:
                n = r.choice([0, 1, 3, 29, 30, 31, 200])
                rows.append((s, seq, x[at : at + n] if n or r.random() < 0.5 else None))
                at, seq = at + n, seq + 1
        df = spark.createDataFrame(rows, "s long, seq long, pcm array<double>").repartition(4)
        for flush in (True, False):
            got = {(f.s, f.frame): list(f.pcm) for f in chunks.frames(df, "s", 30, flush).collect()}
            want = {(s, i // 30): x[i : i + 30] + [0.0] * (30 - len(x[i : i + 30])) for s, x in whole.items() for i in range(0, len(x), 30) if flush or i + 30 <= len(x)}
            assert got == want


def test_long_signals(spark):
    r = np.random.default_rng(3)
    b = r.normal(size=1000)
    a = np.roll(b, 37) + r.normal(size=1000) * 0.1
    mask = r.random(1000) < 0.8
    rows = [(1, k, a[i : i + 61].tolist(), b[i : i + 61].tolist(), mask[i : i + 61].tolist()) for k, i in enumerate(range(0, 1000, 61))] + [(2, 0, [0.0] * 5, [0.0] * 5, None)]
    df = spark.createDataFrame(rows, "s long, seq long, a array<double>, b array<double>, mask array<boolean>").repartition(3)
    lags = [-900, -40, 0, 36, 37, 38, 130]
    got = {(x.s, x.lag): x for x in chunks.compared(chunks.lag_sums(df, "s", 64, lags)).collect()}
    for lag in lags:
        i = np.array([i for i in range(1000) if mask[i] and 0 <= i + lag < 1000])
        p, q = a[i + lag], b[i]
        x = got[1, lag]
        assert x.n == len(i) and abs(x.correlation - p @ q / np.sqrt((p @ p) * (q @ q))) < 1e-9 and abs(x.rmse - np.sqrt(((p - q) ** 2).mean())) < 1e-9
        assert abs(x.snr - 10 * np.log10((p @ p) / ((p - q) @ (p - q)))) < 1e-9
    best = {x.s: x for x in chunks.best_lag(chunks.compared(chunks.lag_sums(df, "s", 64, lags)), "s").collect()}
    assert best[1].lag == 37 and best[1].snr > 15 and (best[2].lag, best[2].correlation, best[2].snr) == (0, 0.0, 120.0)
    found = spark.range(1).select(chunks.delay_candidates(F.lit(40), 100).alias("a"), chunks.delay_candidates(F.lit(3), 32).alias("b"), chunks.delay_candidates(F.lit(99), 100).alias("c")).first()
    assert len(set(found.a)) == len(found.a) == 35 and found.a[:3] == [0, 40, -40] and found.b == list(range(-32, 33)) and max(map(abs, found.c)) == 100


def slow_clip(x, a):
    """One channel, sample by sample."""
    x = [np.float32(min(2.0, max(-2.0, v))) for v in x]
    a = np.float32(a)
    if not a and all(abs(v) <= 1 for v in x):
        return x, 0.0
    for i, v in enumerate(x):
        if v * a >= 0:
            break
        x[i] = v + a * v * v
    head, at = (x[0] if x else 0), 0
    while True:
        i = next((i for i in range(at, len(x)) if abs(x[i]) > 1), None)
        if i is None:
            return x, 0.0
        start, end, peak, ref = i, i, i, x[i]
        while start and ref * x[start - 1] >= 0:
            start -= 1
        while end < len(x) and ref * x[end] >= 0:
            peak, end = (end if abs(x[end]) > abs(x[peak]) else peak), end + 1
        special = start == 0 and ref * x[0] >= 0
        top = abs(x[peak])
        a = (top - 1) / (top * top)
        a += a * np.float32(2.4e-7)
        a = -a if ref > 0 else a
        for k in range(start, end):
            x[k] += a * x[k] * x[k]
        if special and peak >= 2:
            gap = head - x[0]
            step = gap / np.float32(peak)
            for k in range(at, peak):
                gap -= step
                x[k] = min(np.float32(1), max(np.float32(-1), x[k] + gap))
        at = end
        if at == len(x):
            return x, float(a)


@pytest.mark.parametrize("channels", [1, 2])
def test_soft_clip_goes_on_over_chunks(spark, channels):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for s in (0, None, 2):
        n = 40 * 30
        wave = np.stack([1.7 * np.sin(np.arange(n) / (9 + 40 * c)) + r.normal(size=n) * 0.05 for c in range(channels)], 1)
        wave[:200] *= 0.3
        open_ = [0.0] * channels
        for q in range(40):
            x = wave[q * 30 : (q + 1) * 30].astype(np.float32)
            rows.append((s, q, x.ravel().tolist()))
            done = [slow_clip(x[:, c].tolist(), open_[c]) for c in range(channels)]
            open_ = [d[1] for d in done]
            want[s, q] = np.stack([d[0] for d in done], 1).ravel()
    rows += [(7, 0, None), (7, 1, []), (7, 2, [3.0] * channels)]
    df = spark.createDataFrame(rows, "s long, seq long, pcm array<float>").repartition(4)
    out = {(x.s, x.seq): x.clipped for x in chunks.soft_clip(df, "s", channels).collect()}
    assert len(out) == len(rows) and out[7, 0] == out[7, 1] == [] and max(abs(v) for x in out.values() for v in x) <= 1
    for k, x in want.items():
        assert np.allclose(out[k], x, atol=2e-6)
    assert any(not np.allclose(out[s, q], np.clip(x, -1, 1), atol=1e-3) for s, q, x in rows if x and s != 7)


def test_overlaps(spark):
    r = random.Random(4)
    some = lambda n: [(r.randrange(6), a, a + r.choice([0, 1, 5, 100, 2000])) for a in (r.randrange(-500, 3000) for _ in range(n))] + [(None, 0, 10), (1, None, 4)]
    left, right = some(150), some(150)
    a, b = spark.createDataFrame(left, "g long, a long, b long"), spark.createDataFrame(right, "g long, c long, d long")
    want = sorted((g, x, y, c, d) for g, x, y in left for h, c, d in right if g is not None and g == h and None not in (x, c) and max(x, c) < min(y, d))
    joined = intervals.overlaps(a, b, "g", 50)
    assert sorted((x.g, x.a, x.b, x.c, x.d) for x in joined.collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_frame_sizes(spark):
    cases = [(960, None, False, 960), (100, None, False, None), (960, 200, False, 960), (480, 200, False, None), (960, 130, False, None), (960, 25, True, None), (960, 25, False, 120), (5760, 1200, True, 5760), (1000, None, False, None)]
    df = spark.createDataFrame([c[:3] for c in cases], "g int, w int, s boolean")
    assert [x[0] for x in df.select(decisions.frame_size(F.col("g"), F.col("w"), F.col("s"))).collect()] == [c[3] for c in cases]
