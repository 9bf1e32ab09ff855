"""Scans over slices against plain loops, with one group that holds a third of all rows."""

import random

from pyspark.sql import functions as F

from framelake.operators import redundancy, reports, scan, streams


def groups(r, hot=1200):
    """Rows (g, p, x, ok) of a hot group, many small ones and a null group; places are dense."""
    rows = [(g, p, r.choice([0, 3, 5, 8]) if r.random() < 0.9 else None, r.random() < 0.7) for g, n in [(0, hot), (None, 30), *((g, r.randint(1, 40)) for g in range(1, 100))] for p in range(n)]
    r.shuffle(rows)
    return rows


def test_running(spark):
    rows = groups(random.Random(1))
    df = spark.createDataFrame(rows, "g long, p long, x int, ok boolean").repartition(6)
    out = scan.running(df, "g", "p", sums={"s": F.col("x")}, last={"l": F.when(F.col("ok"), F.col("p"))}, before={"b": F.col("x")}, first={"f": F.when(F.col("ok"), F.col("x"))}, most=64)
    got = {(r.g, r.p): (r.s, r.l, r.b, r.f) for r in out.collect()}
    want, held = {}, {}
    for g, p, x, ok in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        s, last, b, f = held.get(g, (None, None, None, None))
        s, last, f = (s or 0) + x if x is not None else s, p if ok else last, f if f is not None else x if ok else None
        want[g, p] = (s, last, b, f)
        held[g] = (s, last, x if x is not None else b, f)
    assert got == want and out.columns == ["g", "p", "x", "ok", "s", "l", "b", "f"]


def test_no_task_has_more_than_a_slice(spark):
    """A third of all rows in one group: slices by measured width, whatever bursts its order has."""
    r = random.Random(2)
    rows = [(0, t) for t in sorted(r.randrange(1000) if r.random() < 0.5 else r.randrange(10**9) for _ in range(2000))] + [(g, r.randrange(10**9)) for g in range(1, 400) for _ in range(10)]
    df = spark.createDataFrame([(g, t, i) for i, (g, t) in enumerate(rows)], "g long, t long, i long").repartition(5)
    width = scan.fitting(df, "g", F.col("t"), 100)
    assert df.groupBy("g", F.floor(F.col("t") / width)).count().agg(F.max("count")).first()[0] <= 100
    got = {(x.g, x.n): (x.t, x.i) for x in scan.numbered(df, "g", ["t", "i"], F.col("t"), "n", 100).collect()}
    want = {}
    for i, (g, t) in enumerate(rows):
        want.setdefault(g, []).append((t, i))
    assert got == {(g, n): x for g, some in want.items() for n, x in enumerate(sorted(some))}
    assert scan.numbered(df.limit(0), "g", ["t", "i"], F.col("t")).count() == 0


def test_past_values_over_borders(spark):
    df = spark.createDataFrame([(g, p) for g in (1, 2) for p in range(50)], "g long, p long")
    got = {(r.g, r.p): list(r.past) for r in scan.with_before(df, "g", "p", 3, F.col("p"), "past", most=8).collect()}
    assert got == {(g, p): list(range(max(0, p - 3), p)) for g in (1, 2) for p in range(50)}


def test_folds(spark):
    """A running mean and a machine of three states, in stretches of four and three levels, against loops."""
    r = random.Random(3)
    rows = [(g, p, float(r.choice([0, 0, 1, 2])), [r.randrange(3) for _ in range(3)]) for g, n in ((0, 150), (None, 9), (2, 1), (3, 64)) for p in range(n)]
    df = spark.createDataFrame(rows, "g long, p long, x double, f array<int>").repartition(4)
    mean = scan.scan(df, "g", "p", scan.affine(0.65, F.col("x")), scan.then, "m", 4).withColumn("m", F.col("m")["fresh"])
    both = scan.scan(mean, "g", "p", F.col("f"), scan.followed, "s", 4)
    got = {(x.g, x.p): (x.m, list(x.s)) for x in both.collect()}
    held = {}
    for g, p, x, f in rows:
        m, s = held.get(g, (0.0, [0, 1, 2]))
        m, s = x if m == 0 else 0.65 * m + 0.35 * x, [f[k] for k in s]
        held[g] = (m, s)
        assert abs(got[g, p][0] - m) < 1e-12 and got[g, p][1] == s
    assert len(got) == len(rows)


def test_stream_operators_over_slices(spark, monkeypatch):
    """The same rows, whatever the slices' size."""
    df = spark.createDataFrame([(s, q, (q * 7 + s) % 11 < 4, float(q % 5), q * 960, bytearray([q % 256] * (1 + q % 3))) for s in range(3) for q in range(120)], "stream_id long, seq long, lost boolean, value double, ts long, payload binary")

    def all_():
        wire = redundancy.add_redundancy(df, 2, 960, 111).select("stream_id", "seq", F.hex("wire").alias("w"))
        parts = [
            streams.fill_forward(df, "value").select("stream_id", "seq", "run", "fade", "filled"), streams.lost_slots(df.filter("not lost")), wire,
            streams.silence_suppressed(df.withColumn("active", F.col("seq") % 37 == 0)).select("stream_id", "seq", "idle", "suppressed"), reports.smoothed(df, "stream_id", "seq", "value", "m").select("stream_id", "seq", F.round("m", 9)),
        ]
        return [sorted(map(tuple, p.collect())) for p in parts]

    whole = all_()
    for name, small in (("running", 16), ("with_before", 16)):
        f = getattr(scan, name)
        g = lambda *a, f=f, small=small, **k: f(*a, **{**k, "most": small})
        for module in (streams, redundancy):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, g)
    assert all_() == whole
