"""Packets and pages as bytes, signals and reports: hand-made cases."""

import math

from pyspark.sql import Row
from pyspark.sql import functions as F

from framelake.functions import container as C
from framelake.functions import layouts as L
from framelake.functions import packets as P
from framelake.functions import pcm as S
from framelake.operators import framing, pages, reports, stats, streams
from framelake.sources import files

A, B, LONG = "48112233", "48445566", "48778899aa"


def table(spark, *packets):
    return spark.createDataFrame([(x, bytearray.fromhex(x)) for x in packets], "name string, payload binary")


def test_frame_codes(spark):
    """Packets of each code, and what must be said of broken ones."""
    good = {A: ["112233"], "49112233445566": ["112233", "445566"], "4a03112233778899aa": ["112233", "778899aa"], "4b830303112233445566778899aa": ["112233", "445566", "778899aa"], "4b4106112233000000000000": ["112233"], "48": [""], "49": ["", ""], "4ac0" + "00" * 192 + "aa": ["00" * 192, "aa"]}
    bad = {
        "": "too short", "4a": "too short", "4b": "too short", "4b41": "too short", "4b42ff": "too short", "4b83fc": "too short", "4900": "invalid packet", "4a05": "invalid packet", "4b0211": "invalid packet", "4b00": "invalid frame count", "4b31": "invalid frame count",
        "fb07" + "00" * 7: "invalid packet", "4b0700": "invalid packet", "4b4105": "invalid packet", "48" + "00" * 1276: "invalid packet", "49" + "00" * 2552: "invalid packet",
    }
    got = {r.name: r for r in framing.with_frames(table(spark, *good, *bad)).collect()}
    assert {k: [bytes(x).hex() for x in got[k].frames] for k in good} == good and not any(got[k].error for k in good)
    assert {k: got[k].error for k in bad} == bad and got["4b4106112233000000000000"].padding == 6
    null = framing.parse(spark.createDataFrame([(None,)], "payload binary")).first()
    assert null.error == "too short" and framing.parse(table(spark, A).limit(0)).count() == 0


def test_packets_are_joined_and_padded(spark):
    groups = {1: [A, B], 2: [A, LONG], 3: [A, B, LONG], 4: [A, "50aa"], 5: [A] * 7, 6: [A, ""]}
    rows = spark.createDataFrame([(g, i, bytearray.fromhex(x)) for g, xs in groups.items() for i, x in enumerate(xs)], "g int, i int, payload binary")
    got = {r.g: (bytes(r.joined or b"").hex(), r.error) for r in framing.regroup(rows, ["g"], "i").collect()}
    assert got == {1: ("49112233445566", None), 2: ("4a03112233778899aa", None), 3: ("4b830303112233445566778899aa", None), 4: ("", "different kinds"), 5: ("", "too long"), 6: ("", "too short")}
    for size, want in ((12, "4b4106112233000000000000"), (4, A), (5, "4b01112233"), (3, None)):
        r = framing.pad(table(spark, A), F.lit(size)).first()
        assert (bytes(r.padded).hex() if r.padded else None) == want and (r.error is None) == (want is not None)
    for size in (259, 260, 261, 515, 2000):
        r = framing.unpad(framing.pad(table(spark, A), F.lit(size)).select("padded"), "padded").first()
        assert len(r.padded) == size and bytes(r.bare).hex() == A


def test_delimited_packets_and_streams(spark):
    names = [A, "49112233445566", "4a03112233778899aa", "4b830303112233445566778899aa"]
    wrapped = framing.with_frames(table(spark, *names)).select("name", F.concat(framing.build(F.col("toc"), F.col("frames"), delimited=True), F.lit(b"more")).alias("p"))
    got = {r.name: (bytes(r.p).hex()[:-8], r.used) for r in framing.with_frames(wrapped, "p", delimited=True).collect()}
    assert got == {A: ("4803112233", 5), names[1]: ("4903112233445566", 8), names[2]: ("4a0304112233778899aa", 10), names[3]: ("4b83030304112233445566778899aa", 15)}
    two = table(spark, "4803112233" + B, "4803112233" + "49" + "4455", "4803", "")
    split = {r.name: ([bytes(x).hex() for x in r.packets or []], r.error) for r in framing.split_streams(two, 2).collect()}
    assert split == {"4803112233" + B: ([A, B], None), "4803112233494455": ([], "different durations"), "4803": ([], "invalid packet"), "": ([], "too short")}


def test_pages_and_headers(spark):
    packets = spark.createDataFrame([(1, 0, 960, bytearray(b"x" * 300)), (1, 1, 960, bytearray(b"")), (2, 0, 480, bytearray(b"y" * 255))], "stream_id long, seq long, samples long, payload binary")
    number = lambda n: F.lit(n).cast("long")
    heads = spark.createDataFrame([(1,), (2,), (3,)], "stream_id long").select("stream_id", C.head(number(2), number(312), number(48_000), number(-5), number(0)).alias("head"), C.tags(F.lit("me"), F.array(F.lit("A=1"), F.lit("no key"), F.lit("A=2=3"))).alias("tags"))
    rows = pages.write_pages(packets, heads).orderBy("stream_id", "page_seq").collect()
    file = b"".join(bytes(r.page) for r in rows)
    broken = bytearray(file)
    broken[-2] ^= 1
    files = spark.createDataFrame([("good", bytearray(file + b"OggSjunk")), ("broken", broken), ("short", bytearray(file[:-1])), ("none", None)], "path string, content binary")
    read = pages.read_pages(pages.cut_pages(files))
    good = read.filter("path = 'good'").orderBy("at").collect()
    assert [(r.serial, r.page_seq, int(r.granule), r.flags, r.error) for r in good] == [(1, 0, 0, 2, None), (1, 1, 0, 0, None), (1, 2, 960, 0, None), (1, 3, 1920, 0, None), (1, 4, 1920, 4, None), (2, 0, 0, 2, None), (2, 1, 0, 0, None), (2, 2, 480, 0, None), (2, 3, 480, 4, None), (3, 0, 0, 2, None), (3, 1, 0, 0, None), (3, 2, 0, 4, None)]
    assert [r.error for r in read.filter("path = 'broken'").orderBy("at").collect()] == [None] * 11 + ["wrong checksum"]
    assert read.filter("path = 'short'").count() == 11 and read.filter("path = 'none'").count() == 0
    assert pages.read_pages(spark.createDataFrame([(bytearray(b"OggX" + b"\0" * 30),), (bytearray(b"OggS"),)], "page binary")).filter("error = 'invalid page'").count() == 2
    one = heads.select(C.read_head(F.col("head")).alias("h"), C.read_tags(F.col("tags")).alias("t"), C.read_head(F.col("tags")).alias("none"), C.read_tags(F.col("head")).alias("nothing")).first()
    assert one.h.asDict() == {"channels": 2, "pre_skip": 312, "rate": 48_000, "gain": -5, "family": 0, "streams": 1, "coupled": 1, "mapping": None} and one.none is None and one.nothing is None
    assert one.t == Row(vendor="me", comments={"A": "2=3"})


def test_signals_and_layouts(spark):
    df = spark.createDataFrame([([1.5, -1.5, 0.25, -0.5, 0.0, 1.0],), ([],)], "p array<double>")
    p = F.col("p")
    r, empty = df.select(
        S.to_symmetric_int16(p).alias("sym"), S.from_bytes(S.to_bytes(S.to_symmetric_int16(p))).alias("back"), S.downmix(p, 2).alias("mono"), S.pan(p, F.lit(-1.0)).alias("left"), S.normalize_peak(p, 0.75).alias("scaled"), S.resample(p, 4, 8).alias("up"), S.resample(p, 2, 1).alias("down"), S.cross_fade(p, p).alias("same"), S.from_int24(S.to_int24(p)).alias("deep"),
    ).collect()
    assert r.sym == r.back == [32767, -32767, 8192, -16384, 0, 32767] and r.mono == [0.0, -0.125, 0.5] and r.scaled == [0.75, -0.75, 0.125, -0.25, 0.0, 0.5]
    assert all(abs(a - b) < 1e-12 for a, b in zip(r.left, [1.5, 0, -1.5, 0, 0.25, 0, -0.5, 0, 0, 0, 1, 0])) and all(abs(a - b) < 1e-12 for a, b in zip(r.same, r.deep))
    assert r.up == [1.5, 0.0, -1.5, -0.625, 0.25, -0.125, -0.5, -0.25, 0.0, 0.5, 1.0, 1.0] and r.down == [1.5, 0.25, 0.0] and all(x == [] for x in empty)
    got = [L.ambisonics(F.lit(n)).alias(f"c{n}") for n in (1, 3, 4, 6, 5, 227, 228)]
    x = spark.range(1).select(*got).first()
    assert (x.c1.order, x.c4.order, x.c6.extra, x.c6.streams, x.c6.coupled, x.c3.coupled, x.c5, x.c227.order, x.c228) == (0, 1, 2, 5, 1, 1, None, 14, None)
    y = spark.range(1).select(L.demix(F.array(F.lit(1.0), F.lit(2.0)), F.array(*map(F.lit, (16384, 0, -32768, 8192))), F.lit(2), F.lit(2)).alias("out"), L.stream_rates(F.lit(256_000), F.lit(4), F.lit(2), F.lit(3)).alias("rates"), S.concealed_chunks(F.lit(2000), F.lit(False)).alias("chunks"), P.find_config(F.lit("silk"), F.lit("full"), F.lit(960)).alias("none")).first()
    assert y.out == [-1.5, 0.5] and sum(y.rates) <= 256_000 and y.rates[0] == y.rates[1] > y.rates[2] > y.rates[3] and y.chunks == [960, 960, 80] and y.none == -1


def test_reports(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 9.0)], "name string, value double")
    guards = spark.createDataFrame([("a", 2.0), ("b", 9.0), ("c", 1.0)], "name string, most double")
    assert sorted((r.name, r.why) for r in reports.violations(rows, guards, "name", "value", "most").collect()) == [("a", "above"), ("c", "missing")]
    wave = [math.sin(i * i / 7) for i in range(60)]
    pairs = spark.createDataFrame([(1, wave, wave[5:]), (2, wave[3:], wave), (3, wave, wave), (4, [0.0] * 60, wave)], "block_id int, a array<double>, b array<double>")
    got = {r.block_id: (r.delay, round(r.correlation, 6)) for r in reports.best_delay(pairs, 16, 1).collect()}
    assert got == {1: (5, 1), 2: (-3, 1), 3: (0, 1), 4: (0, 0)}
    one = spark.range(1).select(reports.quality(F.lit(0.0)).alias("best"), reports.resilience(*map(F.lit, (10.0, 50.0, 100, 4, 240.0, 0))).alias("score"), reports.failed_bars(F.lit(1.0), F.lit(0.5), F.lit(2.0), 2, 0, 0.9, 1.1).alias("failed")).first()
    assert one.best == 100 and one.score == 12 + 15 + 15 + 2 + 2 + 10 and one.failed == ["q", "loud"]
    series = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 0, 10, 20])], "g int, i int, v double")
    assert [round(r.s, 6) for r in reports.smoothed(series, "g", "i", "v", "s").orderBy("i").collect()] == [0, 0, 10, 13.5]


def test_optimized_plans_stay_small(spark, sf_dir):
    """A filter on what was parsed must not carry the parser's expressions down through every step."""
    from framelake.plans.registry import QUERIES

    for name in ("redundant_blocks", "recovery_cascade", "packet_parse", "stream_split", "padded_packets", "page_round_trip"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 300_000, (name, len(plan))


def test_files(spark, tmp_path):
    record = b"\0\0\0\3\xff\0\0\1abc" + b"\0\0\0\0\0\0\0\2"
    rows = spark.createDataFrame([("whole", bytearray(record * 2)), ("cut", bytearray(record[:10])), ("tail", bytearray(record + b"\0\0\0\1")), ("none", None)], "path string, content binary")
    got = sorted((r.path, r.seq, r.final_range, bytes(r.payload) if r.payload else None) for r in files.vectors(rows).collect())
    one = [(0xFF000001, b"abc"), (2, None)]
    assert got == [("tail", i, *x) for i, x in enumerate(one)] + [("whole", i, *x) for i, x in enumerate(one * 2)]
    (tmp_path / "f.json").write_text('{"version": 3, "cases": [{"name": "x", "frames": 2},\n {"name": "y", "frames": null}]}')
    assert [(r.version, r.name, r.frames) for r in files.fixtures(spark, str(tmp_path / "f.json")).collect()] == [(3, "x", 2), (3, "y", None)]
    made = spark.createDataFrame([("a", [1, -2, 32767, -32768]), ("b", [])], "path string, pcm array<int>").select("path", files.to_wav(F.col("pcm"), F.lit(2), F.lit(8000)).alias("content"))
    data = {r.path: bytes(r.content) for r in made.collect()}
    assert data["a"][:4] == b"RIFF" and len(data["a"]) == 52
    data["list"] = data["a"][:36] + b"LIST\3\0\0\0abc\0" + data["a"][36:]  # a chunk of odd length before the samples
    data |= {"float": data["a"][:20] + b"\3" + data["a"][21:], "junk": b"RIFF", "empty": b""}
    read = {r.path: r for r in files.wav(spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "path string, content binary")).collect()}
    assert read["a"].pcm == read["list"].pcm == [1, -2, 32767, -32768] and (read["a"].channels, read["a"].rate, read["a"].error) == (2, 8000, None)
    assert [read[k].error for k in ("float", "junk", "empty")] == ["no 16-bit PCM"] * 3


def test_silence(spark):
    rows = spark.createDataFrame([(1, i, i in (0, 60)) for i in range(75)] + [(2, i, None) for i in range(12)], "stream_id int, seq int, active boolean")
    got = {(r.stream_id, r.seq): r.suppressed for r in streams.silence_suppressed(rows).collect()}
    sent = [i for i in range(75) if not got[1, i]]
    assert sent == [*range(11), 31, 52, *range(60, 71)] and [got[2, i] for i in (9, 10)] == [False, True]


def test_mismatches(spark):
    schema = "stream_id int, seq int, payload string"
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, None), (2, 0, "x"), (3, 0, "z")], schema)
    b = spark.createDataFrame([(1, 0, "x"), (1, 1, "q"), (1, 2, None), (1, 3, "w"), (2, 0, "x")], schema)
    assert {r.stream_id: tuple(r)[1:] for r in stats.mismatches(a, b).collect()} == {1: (3, 1, 1), 2: (1, 0, -1)}
