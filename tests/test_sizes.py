"""Queries against their SQL on tables that go beyond the given ones."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from framelake.plans.registry import ORACLE_SQL, QUERIES


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over these tables, sorted."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, folder / f"{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    ours = QUERIES[name](spark, str(folder))
    columns = sorted(ours.columns)
    theirs = con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple(map(repr, r))
    return sorted((tuple(r) for r in ours.select(*columns).collect()), key=key), sorted(theirs, key=key)


def test_rates_above_32_bits(spark, tmp_path):
    """Block 89,478 has the last rate that a header holds, 4,294,952,000."""
    ids = [0, 1, 89_477, 89_478, 89_479, 89_480, 102_563, 10**9]
    table = pa.table({"vec_id": pa.array(ids * 2, pa.int64()), "embedding": pa.array([[0.5]] * 16, pa.list_(pa.float32())), "label": pa.array([1] * 8 + [5] * 8, pa.int32())})
    ours, theirs = both(spark, tmp_path, "stream_headers", embeddings=table)
    assert ours == theirs and len(ours) == 16
    rows = QUERIES["stream_headers"](spark, str(tmp_path)).filter("valid").select("stream_id", "rate").distinct().collect()
    assert {r.stream_id for r in rows} == set(ids[:4]) and max(r.rate for r in rows) == 4_294_952_000


def test_tables_read_twice_are_written(spark, sf_dir):
    """What several steps read is worked out once: the plans that are left read tables, and neither write nor read pages or extensions."""
    for name in ("page_round_trip", "extension_round_trip"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "crc32" not in plan and "ArrowEvalPython" not in plan, name


def test_malformed_delimited_packets(spark):
    """A count byte of no frame, or of 49, where the length of one is asked for."""
    from pyspark.sql import functions as F

    from framelake.operators import framing

    rows = spark.createDataFrame([(bytearray(b"\xfb\x80"),), (bytearray(b"\xfb\xb1\x01"),)], "payload binary")
    assert [r.error for r in framing.parse(rows, delimited=True).select(F.col("error")).collect()] == ["invalid packet"] * 2


def test_lengths_that_cannot_be_written():
    """A frame above 1,275 bytes has no length code: no packet, not one without that length."""
    from framelake.functions.frames import built

    assert built(0x48, [bytes(1276), b"a"]) is None and built(0x48, [bytes(1275), b"a"])[:3] == b"\x4a\xff\xff" and built(0x48, [bytes(1276)], delimited=True) is None
