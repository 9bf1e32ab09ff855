"""Streaming operators over files that come one after the other."""

from framelake.streaming.losses import arrivals_with_losses
from framelake.streaming.mixer import mix_arrivals


def test_losses_over_triggers(spark, tmp_path):
    schema = "stream_id long, arrival long, seq int"
    batches = [[(1, 0, 65533), (1, 1, 65534), (2, 0, 5), (None, 0, 1)], [(1, 3, 1), (1, 4, 0), (2, 1, 105), (3, 0, None)], [(1, 5, 102), (1, 6, 2)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = arrivals_with_losses(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert query.exception() is None
    out = {(r.stream_id, r.seq, r.kind, r.ago) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    received = {(1, s, "received", 0) for s in (65533, 65534, 1, 102)} | {(2, 5, "received", 0), (2, 105, "received", 0)}
    old = {(1, 0, "old", 0), (1, 2, "old", 0)}
    # stream 1 waits for 2 when 102 comes, a gap of 100, which is a jump; stream 2 misses 6 to 104
    lost = {(1, 65535, "lost", 2), (1, 0, "lost", 1)} | {(2, s, "lost", 105 - s) for s in range(6, 105)}
    assert out == received | lost | old


def test_mixing_over_triggers(spark, tmp_path):
    schema = "mixer_id long, arrival long, kind string, track string, start long, value double, pcm array<double>"
    at = lambda i, kind, track=None, start=None, value=None, pcm=None: (1, i, kind, track, start, value, pcm)
    batches = [
        [at(0, "add", "a", value=2.0), at(1, "add", "b"), at(2, "segment", "a", 2, pcm=[1.0] * 4), at(3, "segment", "c", 0, pcm=[1.0]), at(4, "segment", "b", 9, pcm=[1.0]), at(5, "segment", "b", 8, pcm=[5.0]), (None, 5, "tick", None, None, None, None), at(6, "tick")],
        [at(7, "segment", "b", 1, pcm=[1.0] * 3), at(8, "segment", "b", 2, pcm=[1.0] * 3), at(9, "segment", "c", 0, pcm=[1.0]), at(10, "segment", "b", -1, pcm=[1.0]), at(11, "segment", "b", 5, pcm=[]), at(12, "gain", "a", value=3.0), at(13, "tick")],
        [at(14, "mute", "b", value=1.0), at(15, "segment", "a", 8, pcm=[1.0] * 8), at(16, "tick"), at(17, "remove", "a"), at(18, "tick")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = mix_arrivals(stream, 4, 8).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert query.exception() is None
    out = {r.arrival: (r.kind, r.start, r.pcm) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {k: v[0] for k, v in out.items()} == {2: "taken", 3: "unknown", 4: "early", 5: "taken", 6: "mixed", 7: "late", 8: "taken", 9: "late", 13: "mixed", 15: "taken", 16: "mixed", 18: "mixed"}
    assert out[6][1:] == (0, [0.0, 0.0, 2.0, 2.0]) and out[13][1:] == (4, [4.0, 3.0, 0.0, 0.0]) and out[16][1:] == (8, [3.0] * 4) and out[18][1:] == (12, [0.0] * 4)


def test_playout_by_timer(spark, tmp_path):
    """Without ticks: windows come by themselves some time after the first segment, in order, until no segment waits; what came too late is told."""
    schema = "mixer_id long, arrival long, kind string, track string, start long, value double, pcm array<double>"
    rows = [(1, 0, "add", "a", None, 2.0, None), (1, 1, "segment", "a", 0, None, [1.0] * 4), (1, 2, "segment", "a", 6, None, [1.0] * 2), (1, 3, "segment", "a", 20, None, [1.0]), (2, 0, "add", "b", None, None, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    mixed = mix_arrivals(stream, 4, 8, delay=300, idle=3_600_000)
    query = mixed.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            out = spark.read.schema(mixed.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect() if query.lastProgress else []
            if sum(r.kind == "mixed" for r in out) >= 2:
                break
        query.awaitTermination(3)
        out = spark.read.schema(mixed.schema).parquet(f"{tmp_path}/out").collect()
    finally:
        query.stop()
    assert [(r.start, list(r.pcm)) for r in sorted((r for r in out if r.kind == "mixed"), key=lambda r: r.start)] == [(0, [2.0] * 4), (4, [0.0, 0.0, 2.0, 2.0])]
    assert sorted((r.arrival, r.kind) for r in out if r.kind != "mixed") == [(1, "taken"), (2, "taken"), (3, "early")]
