"""Every query against the same in DuckDB, and hand-made packets and signals."""

import duckdb
import pytest
from pyspark.sql import functions as F

from framelake.functions import layouts as L
from framelake.functions import packets as P
from framelake.functions import pcm as S
from framelake.operators import pages, redundancy, stats, streams
from framelake.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("events", "embeddings"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda t: [tuple(None if x != x or x is None else float(x) if isinstance(x, (int, float)) else str(x) for x in r) for r in t[columns].astype(object).where(t[columns].notna(), None).itertuples(index=False)]
    key = lambda r: tuple(map(repr, r))
    assert sorted(rows(ours), key=key) == sorted(rows(theirs), key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE_SQL) == set(QUERIES)


def test_headers(spark):
    df = spark.createDataFrame([(0x48, 0), (0x78, 0), (0xFB, 49), (0xFB, 0), (0xFB, 6), (0xFB, 7), (0x1B, 2), (0x1B, 3)], "toc int, b int")
    toc, b = F.col("toc"), F.col("b")
    got = df.select(P.mode(toc), P.bandwidth(toc), P.frame_samples(toc), P.frames_lenient(toc, b), P.frames_strict(toc, b)).collect()
    assert [tuple(r) for r in got] == [
        ("silk", "wide", 960, 1, 1), ("hybrid", "full", 960, 1, 1), ("celt", "full", 960, 49, None), ("celt", "full", 960, 0, None), ("celt", "full", 960, 6, 6),
        ("celt", "full", 960, 7, None), ("silk", "narrow", 2880, 2, 2), ("silk", "narrow", 2880, 3, None),
    ]
    assert all(r.a == r.b for r in spark.range(256).select(F.col("id").alias("a"), P.build_toc(P.config(F.col("id")), P.stereo(F.col("id")), P.code(F.col("id"))).alias("b")).collect())


def test_losses_and_jumps(spark):
    df = spark.createDataFrame([(1, s) for s in (0, 1, 4, 104, 205)] + [(2, 7)], "stream_id long, seq long")
    got = {(r.stream_id, r.seq): r.ago for r in streams.lost_slots(df).collect()}
    assert {k for k in got if k[1] < 5} == {(1, 2), (1, 3)} and got[1, 3] == 1 and got[1, 2] == 2
    assert sum(k[1] > 4 for k in got) == 99  # 5 to 103; the gap of 100 after 104 is a jump
    assert streams.lost_slots(df.limit(0)).count() == 0


def test_signals(spark):
    df = spark.createDataFrame([([0.5 / 32768, 1.5 / 32768, 2.0, -2.0, 0.0],), ([],)], "pcm array<double>")
    p = F.col("pcm")
    got = df.select(S.to_int16(p), S.energy(S.from_int16(S.to_int16(p))), S.trim_silence(p, 0.1, 0), S.channel(p, 2, 1), S.is_silent(p)).collect()
    assert got[0][0] == [0, 2, 32767, -32768, 0] and got[0][2] == [2.0, -2.0] and got[0][3] == [1.5 / 32768, -2.0] and not got[0][4]
    assert got[1][1] == 0 and got[1][2] == [] and got[1][4]


def test_constant_signals(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0], [1.0, 1.0]), (2, [1.0, 1.0], [1.0, 2.0]), (3, [1.0, 2.0, 9.0], [2.0, 4.0])], "block_id long, a array<double>, b array<double>")
    got = {r.block_id: r for r in stats.compare_blocks(df).collect()}
    assert got[1].correlation == 1 and got[1].snr == 120 and got[2].correlation == 0 and got[3].correlation == 1


def test_percentiles(spark):
    df = spark.createDataFrame([("a", v) for v in range(1, 21)] + [("b", 7)], "g string, v long")
    got = {r.g: r for r in stats.percentiles(df, "g", "v").collect()}
    assert (got["a"].p95_floor, got["a"].p95, got["a"].upper_median) == (20, 19, 11) and (got["b"].p95_floor, got["b"].p95) == (7, 7)


def test_redundancy_errors(spark):
    one = "EF000F02"  # type 111, offset 3, length 770
    cases = {
        "": "empty payload", "EF": "truncated redundant header", "6E": "unexpected primary type", "EF000401": "truncated header", "EF000001": "invalid redundant block",
        "EE000401": "unexpected redundant type", "EF000401" * 6 + "6F": "too many blocks", one + "6F01": "truncated redundant payload", "EF0004016FAA": "missing primary", "6F": "missing primary",
        "6FAB": None, "EF0004016FAABB": None,
    }
    df = spark.createDataFrame([(k, bytearray.fromhex(k)) for k in cases] + [("null", None)], "name string, wire binary")
    got = {r.name: r for r in redundancy.split_redundancy(df, 111).collect()}
    assert {k: got[k].error for k in cases} == cases and got["null"].error == "empty payload"
    assert bytes(got["6FAB"].primary) == b"\xab" and got["6FAB"].blocks == []
    assert [(b.offset, bytes(b.payload)) for b in got["EF0004016FAABB"].blocks] == [(1, b"\xaa")] and bytes(got["EF0004016FAABB"].primary) == b"\xbb"


def test_redundancy_eligibility(spark):
    rows = [(1, 0, 2**32 - 960, b"a"), (1, 1, 0, b"b"), (1, 2, 961, b"c"), (1, 3, 1920, b"d"), (1, 4, 90_000, b""), (1, 5, 90_960, b"e")]
    df = spark.createDataFrame([(s, q, t, bytearray(p)) for s, q, t, p in rows], "stream_id long, seq long, ts long, payload binary")
    got = {r.seq: r for r in redundancy.split_redundancy(redundancy.add_redundancy(df, 2, 960, 111), 111).collect()}
    assert [(b.offset, bytes(b.payload)) for b in got[1].blocks] == [(960, b"a")]  # across the wrap
    assert got[2].blocks == [] and [b.offset for b in got[3].blocks] == [2880, 1920] and got[4].error == "empty payload" and got[5].blocks == []


def test_pages(spark):
    x, y = b"x" * 300, b"y" * 255
    rows = [(1, 0, True, [7], b"nothing"), (1, 1, False, [3, 0, 255], b"abc" + x[:255]), (1, 2, True, [45, 255, 0], x[255:] + y), (1, 3, False, [255], y), (1, 4, False, [2, 255], b"no" + y), (2, 0, False, [2], b"hi")]
    df = spark.createDataFrame([(s, q, c, g, bytearray(p)) for s, q, c, g, p in rows], "serial long, page_seq long, continued boolean, segments array<int>, payload binary")
    got = sorted((r.serial, r.packet, r.last_page, bytes(r.payload)) for r in pages.packets_of_pages(df).collect())
    assert [(s, q, p) for s, _, q, p in got] == [(1, 1, b"abc"), (1, 2, x), (1, 2, y), (1, 4, b"no"), (2, 0, b"hi")]
    assert pages.packets_of_pages(df.limit(0)).count() == 0


def test_layouts(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0, 4.0], [5.0, 6.0]], [0, 2, 1, 255], 1, 2), ([], [0], 0, 0)], "s array<array<double>>, m array<int>, c int, n int")
    got = df.select(L.map_channels(F.col("s"), F.col("m"), F.col("c"), F.col("n")).alias("x")).collect()
    assert got[0].x == [1.0, 5.0, 2.0, 0.0, 3.0, 6.0, 4.0, 0.0] and got[1].x == []
    assert spark.range(12).filter(L.layout(F.col("id")).isNotNull()).count() == 8
    assert [r.x for r in spark.createDataFrame([([255, 0, 3, 255],), ([],)], "s array<int>").select(L.laced_lengths(F.col("s")).alias("x")).collect()] == [[255, 3], []]
