"""All queries of the library, by name, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import layouts as L
from framelake.functions import packets as P
from framelake.functions import pcm as S
from framelake.functions.layouts import LAYOUTS
from framelake.operators import redundancy, stats, streams
from framelake.plans import flows, measures, wire  # noqa: F401  (they register their queries)
from framelake.plans.base import BANDWIDTH, FRAMES, LOST, MODE, ORACLE_SQL, QUERIES, SIZE, STRICT, WITH, query  # noqa: F401
from framelake.sources.adapters import FRAME, blocks, headers, packets

RUNS = f"""{WITH}, good AS (SELECT *, last_value(CASE WHEN NOT lost THEN seq END IGNORE NULLS) OVER w AS g, last_value(CASE WHEN NOT lost THEN value END IGNORE NULLS) OVER w AS v
    FROM packets WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING)), runs AS (SELECT *, CASE WHEN lost THEN seq - coalesce(g, -1) ELSE 0 END AS run FROM good)"""

@query(f"{WITH} SELECT {MODE} AS mode, {BANDWIDTH} AS bandwidth, toc % 8 >= 4 AS stereo, count(*) AS packets, sum({SIZE})::BIGINT AS samples, round(avg(len), 6) AS mean_len FROM packets GROUP BY ALL")
def packets_by_mode(spark, sf_dir: str) -> DataFrame:
    return stats.by_mode(headers(spark, sf_dir))


@query(f"""{WITH} SELECT event_id, toc // 8 AS config, toc % 8 >= 4 AS stereo, toc % 4 AS code, {SIZE} AS frame_samples, {FRAMES} AS frames, {STRICT} AS frames_strict, {FRAMES} * {SIZE} AS samples,
    len // 255 + 1 AS segments, toc AS built FROM packets""")
def packet_headers(spark, sf_dir: str) -> DataFrame:
    frames = P.frames_lenient(F.col("toc"), F.col("second_byte"))
    return headers(spark, sf_dir).select(
        "event_id", P.config(F.col("toc")).alias("config"), P.stereo(F.col("toc")).alias("stereo"), P.code(F.col("toc")).alias("code"), P.frame_samples(F.col("toc")).alias("frame_samples"), frames.alias("frames"),
        P.frames_strict(F.col("toc"), F.col("second_byte")).alias("frames_strict"), (frames * P.frame_samples(F.col("toc"))).alias("samples"),
        P.segments(F.col("len")).alias("segments"), P.build_toc(P.config(F.col("toc")), P.stereo(F.col("toc")), P.code(F.col("toc"))).alias("built"),
    )


@query(f"{WITH} SELECT {MODE} AS mode, sum({SIZE} // 6)::BIGINT AS samples_8k, sum({SIZE} // 3)::BIGINT AS samples_16k, sum({SIZE} // 2)::BIGINT AS samples_24k FROM packets GROUP BY ALL")
def samples_by_rate(spark, sf_dir: str) -> DataFrame:
    at = lambda rate: F.sum(P.frame_samples(F.col("toc"), rate)).alias(f"samples_{rate // 1000}k")
    return headers(spark, sf_dir).groupBy(P.mode(F.col("toc")).alias("mode")).agg(at(8000), at(16000), at(24000))


@query(f"{LOST} SELECT * FROM slots")
def lost_packets(spark, sf_dir: str) -> DataFrame:
    return streams.lost_slots(packets(spark, sf_dir).filter(~F.col("lost")))


@query(f"""{WITH} SELECT stream_id, count(*) AS packets, count_if(lost)::BIGINT AS lost, round(100.0 * count_if(lost) / count(*), 6) AS loss_percent,
    round(sum(CASE WHEN NOT lost THEN len ELSE 0 END) * 8 * 48.0 / (count(*) * {FRAME}), 6) AS kbps FROM packets GROUP BY stream_id""")
def link_counters(spark, sf_dir: str) -> DataFrame:
    n, bad = F.count("*"), F.count_if("lost")
    kbps = F.sum(F.when(~F.col("lost"), F.col("len")).otherwise(0)) * 8 * 48.0 / (n * FRAME)
    return headers(spark, sf_dir).groupBy("stream_id").agg(n.alias("packets"), bad.alias("lost"), F.round(100.0 * bad / n, 6).alias("loss_percent"), F.round(kbps, 6).alias("kbps"))


@query(f"{WITH} SELECT stream_id, count_if(toc < 96)::BIGINT AS silk, count_if(toc BETWEEN 96 AND 127)::BIGINT AS hybrid, count_if(toc >= 128)::BIGINT AS celt FROM packets GROUP BY stream_id")
def mode_counters(spark, sf_dir: str) -> DataFrame:
    modes = headers(spark, sf_dir).select("stream_id", P.mode(F.col("toc")).alias("mode"))
    return modes.groupBy("stream_id").pivot("mode", ["silk", "hybrid", "celt"]).count().na.fill(0)


@query(f"{RUNS} SELECT stream_id, seq, run, CASE WHEN pow(0.57, run) < 0.001 THEN 0.0 ELSE round(pow(0.57, run), 9) END AS fade FROM runs WHERE lost")
def loss_fade(spark, sf_dir: str) -> DataFrame:
    return streams.loss_runs(packets(spark, sf_dir)).filter("lost").select("stream_id", "seq", "run", F.round("fade", 9).alias("fade"))


@query(f"{RUNS} SELECT stream_id, max(run) AS longest, count_if(run = 1)::BIGINT AS runs FROM runs GROUP BY stream_id")
def longest_loss(spark, sf_dir: str) -> DataFrame:
    return streams.loss_runs(packets(spark, sf_dir)).groupBy("stream_id").agg(F.max("run").alias("longest"), F.count_if(F.col("run") == 1).alias("runs"))


@query(f"{RUNS} SELECT stream_id, seq, round(CASE WHEN lost THEN coalesce(v, 0) * greatest(0.2, pow(0.9, run)) ELSE value END, 6) AS filled FROM runs")
def fill_forward(spark, sf_dir: str) -> DataFrame:
    return streams.fill_forward(packets(spark, sf_dir), "value").select("stream_id", "seq", F.round("filled", 6).alias("filled"))


@query(f"{WITH} SELECT stream_id, seq, {FRAMES} * {SIZE} AS samples, (sum({FRAMES} * {SIZE}) OVER (PARTITION BY stream_id ORDER BY seq))::BIGINT AS granule FROM packets")
def cumulative_granule(spark, sf_dir: str) -> DataFrame:
    return streams.granules(packets(spark, sf_dir)).select("stream_id", "seq", "samples", "granule")


@query(f"""{WITH}, g AS (SELECT stream_id, seq, (sum({FRAMES} * {SIZE}) OVER (PARTITION BY stream_id ORDER BY seq))::BIGINT AS granule FROM packets)
    SELECT stream_id, min(seq) AS seq, min(granule) AS granule FROM g WHERE granule >= 48000 GROUP BY stream_id""")
def seek_granule(spark, sf_dir: str) -> DataFrame:
    return streams.seek(streams.granules(packets(spark, sf_dir)), 48_000)


SEGMENTS = f"{WITH}, segments AS (SELECT stream_id, event_id, {FRAME} * (seq + event_id * 31 % 9 - 4) AS start, 480 + event_id % 3 * 480 AS length, seq * {FRAME} AS cursor, event_id % 10 AS gain FROM packets)"


def _segments(spark, sf_dir: str) -> DataFrame:
    e, seq = F.col("event_id"), F.col("seq")
    return packets(spark, sf_dir).select("stream_id", e, (FRAME * (seq + e * 31 % 9 - 4)).alias("start"), (480 + e % 3 * 480).alias("length"), (seq * FRAME).alias("cursor"), (e % 10).alias("gain"))


@query(f"{SEGMENTS} SELECT event_id, CASE WHEN start + length <= cursor THEN 'late' WHEN start > cursor + {2 * FRAME} THEN 'early' ELSE 'taken' END AS verdict FROM segments")
def mixer_arrivals(spark, sf_dir: str) -> DataFrame:
    return streams.arrivals(_segments(spark, sf_dir), 2 * FRAME).select("event_id", "verdict")


@query(f"""{SEGMENTS}, touched AS (SELECT *, unnest(range(start // {FRAME}, (start + length - 1) // {FRAME} + 1)) AS "window" FROM segments WHERE start >= 0)
    SELECT "window", count(*) AS tracks, sum(gain * (least(start + length, ("window" + 1) * {FRAME}) - greatest(start, "window" * {FRAME})))::BIGINT AS level FROM touched GROUP BY "window" """)
def timeline_mix(spark, sf_dir: str) -> DataFrame:
    return streams.mix(_segments(spark, sf_dir).filter("start >= 0"))


@query(f"""{WITH}, rows AS (SELECT stream_id, seq // 3 AS part, seq, toc, len, coalesce({STRICT}, 0) AS frames, coalesce({STRICT}, 0) * {SIZE} AS samples FROM packets)
    SELECT stream_id, part, arg_min(toc, seq) AS first_toc, count(*) AS packets, sum(frames)::BIGINT AS frames, sum(len)::BIGINT AS bytes, CASE WHEN min(toc // 4) <> max(toc // 4) THEN 'different kinds'
    WHEN min(frames) = 0 THEN 'invalid packet' WHEN sum(frames) > 48 OR sum(samples) > 5760 THEN 'too long' END AS error FROM rows GROUP BY stream_id, part""")
def regroup_frames(spark, sf_dir: str) -> DataFrame:
    return streams.regroup(packets(spark, sf_dir))


@query(f"""{WITH}, v AS (SELECT {MODE} AS mode, list_sort(list(len)) AS l, avg(len) AS mean, avg(ln(len)) AS g FROM packets GROUP BY ALL)
    SELECT mode, len(l) AS n, round(mean, 6) AS mean, l[least(len(l) * 95 // 100, len(l) - 1) + 1] AS p95_floor, l[ceil(len(l) * 0.95)::INT] AS p95, l[len(l) // 2 + 1] AS upper_median, round(exp(g), 6) AS geomean FROM v""")
def length_percentiles(spark, sf_dir: str) -> DataFrame:
    return stats.percentiles(headers(spark, sf_dir).select(P.mode(F.col("toc")).alias("mode"), "len"), "mode", "len")


PAIRS = f"{WITH}, moved AS (SELECT *, len + (event_id * 11 % 7) - 3 AS len_b, (toc + CASE WHEN event_id % 17 = 0 THEN 64 ELSE 0 END) % 256 AS toc_b FROM packets)"


def _pairs(spark, sf_dir: str) -> DataFrame:
    e, other = F.col("event_id"), (F.col("toc") + F.when(F.col("event_id") % 17 == 0, 64).otherwise(0)) % 256
    return headers(spark, sf_dir).select(F.col("len").alias("len_a"), (F.col("len") + e * 11 % 7 - 3).alias("len_b"), P.mode(F.col("toc")).alias("mode_a"), P.mode(other).alias("mode_b"))


@query(f"""{PAIRS} SELECT count(*) AS n, round(avg(abs(len - len_b)), 6) AS mean_difference, quantile_disc(abs(len - len_b), 0.95) AS p95_difference,
    round(avg(CASE WHEN {MODE} <> {MODE.replace("toc", "toc_b")} THEN 1.0 ELSE 0.0 END), 6) AS mode_mismatch,
    round(({" + ".join(f"abs(count_if({MODE} = '{m}') - count_if({MODE.replace('toc', 'toc_b')} = '{m}'))" for m in ("silk", "hybrid", "celt"))}) / count(*)::DOUBLE, 6) AS histogram_distance FROM moved""")
def packet_profile(spark, sf_dir: str) -> DataFrame:
    return stats.profile(_pairs(spark, sf_dir))


@query(f"""{WITH}, pairs AS (SELECT a.stream_id, a.seq, md5((a.event_id % 4)::VARCHAR) <> md5((b.event_id % 4)::VARCHAR) AS differs FROM packets a JOIN packets b ON b.stream_id = a.stream_id + 1 AND b.seq = a.seq)
    SELECT stream_id, count(*) AS compared, count_if(differs)::BIGINT AS mismatches, coalesce(min(seq) FILTER (WHERE differs), -1) AS first_mismatch FROM pairs GROUP BY stream_id""")
def payload_mismatch(spark, sf_dir: str) -> DataFrame:
    """Payloads of each stream against those of the next, place by place."""
    rows = packets(spark, sf_dir).select("stream_id", "seq", F.md5((F.col("event_id") % 4).cast("string").cast("binary")).alias("payload"))
    return stats.mismatches(rows, rows.withColumn("stream_id", F.col("stream_id") - 1))


@query(f"{WITH} SELECT stream_id, round(avg(len), 6) AS mean_len FROM packets GROUP BY stream_id ORDER BY mean_len, stream_id LIMIT 10")
def lowest_streams(spark, sf_dir: str) -> DataFrame:
    return stats.lowest(headers(spark, sf_dir).groupBy("stream_id").agg(F.round(F.avg("len"), 6).alias("mean_len")), "mean_len", "stream_id", 10)


ENERGY = "list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))"


@query(f"""SELECT vec_id AS block_id, round({ENERGY} / len(embedding), 6) AS energy, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS peak,
    list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) <= 1.0 / 256 AS silent FROM embeddings""")
def block_levels(spark, sf_dir: str) -> DataFrame:
    p = F.col("pcm")
    return blocks(spark, sf_dir).select("block_id", F.round(S.energy(p), 6).alias("energy"), F.round(S.peak(p), 6).alias("peak"), S.is_silent(p, 8).alias("silent"))


@query("""SELECT vec_id AS block_id, list_sum(list_transform(embedding, lambda x: greatest(-32768, least(32767, round_even(x::DOUBLE * 32768, 0))))::INT[])::BIGINT AS sum16,
    list_sum(list_transform(embedding, lambda x: round_even(x::DOUBLE * 8388608, 0)::BIGINT))::BIGINT AS sum24 FROM embeddings""")
def block_integers(spark, sf_dir: str) -> DataFrame:
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return blocks(spark, sf_dir).select("block_id", total(S.to_int16(F.col("pcm"))).alias("sum16"), total(S.to_int24(F.col("pcm"))).alias("sum24"))


@query("""WITH p AS (SELECT a.vec_id AS block_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    s AS (SELECT block_id, len(a) AS n, list_sum(a) AS sa, list_sum(b) AS sb, list_dot_product(a, a) AS saa, list_dot_product(b, b) AS sbb, list_dot_product(a, b) AS sab,
    list_sum(list_transform(list_zip(a, b), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS sdd FROM p)
    SELECT block_id, round((sab - sa * sb / n) / sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)), 4) AS correlation, round(sqrt(sbb / saa), 4) AS rms_ratio, round(sqrt(sdd / n), 4) AS rmse,
    round(CASE WHEN sdd = 0 THEN 120.0 ELSE 10 * log10(saa / sdd) END, 3) AS snr FROM s""")
def block_comparison(spark, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir)
    other = rows.select((F.col("block_id") - 1).alias("block_id"), F.col("pcm").alias("b"))
    return stats.compare_blocks(rows.select("block_id", F.col("pcm").alias("a")).join(other, "block_id"))


@query(f"""{WITH}, p AS (SELECT event_id, stream_id, seq, substr(repeat(md5(event_id::VARCHAR), 4), 1, len) AS body FROM packets)
    SELECT a.event_id, (CASE WHEN a.seq = 1 THEN 0 ELSE 2 - a.seq + b.seq END)::INT AS place, (a.seq - b.seq) * {FRAME} AS "offset", b.body AS block, a.body AS "primary"
    FROM p a JOIN p b ON a.stream_id = b.stream_id AND b.seq BETWEEN a.seq - 2 AND a.seq - 1""")
def redundant_blocks(spark, sf_dir: str) -> DataFrame:
    """Payloads with two earlier ones each, put on the wire and taken apart again."""
    body = F.substring(F.repeat(F.md5(F.col("event_id").cast("string").cast("binary")), 4), F.lit(1), F.col("len").cast("int")).cast("binary")
    rows = packets(spark, sf_dir).select("event_id", "stream_id", "seq", F.col("ts48").alias("ts"), body.alias("payload"))
    parsed = redundancy.split_redundancy(redundancy.add_redundancy(rows, 2, FRAME, 111).select("event_id", "wire"), 111)
    return parsed.select("event_id", F.posexplode("blocks").alias("place", "b"), F.col("primary").cast("string").alias("primary")).select("event_id", "place", "b.offset", F.col("b.payload").cast("string").alias("block"), "primary")


ROUTES = ", ".join(f"({n}, {coupled}, {at}, {coded})" for n, (_, coupled, mapping) in LAYOUTS.items() for at, coded in enumerate(mapping))


@query(f"""SELECT vec_id AS block_id, channel, CASE WHEN coded < 2 * coupled THEN coded // 2 ELSE coded - coupled END AS stream, CASE WHEN coded < 2 * coupled THEN coded % 2 ELSE 0 END AS side
    FROM embeddings JOIN (VALUES {ROUTES}) r(channels, coupled, channel, coded) ON label % 8 + 1 = channels""")
def channel_routes(spark, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).select("block_id", L.layout(F.col("channels")).alias("x"))
    routed = rows.select("block_id", "x.coupled", F.posexplode("x.mapping").alias("channel", "coded"))
    return routed.select("block_id", "channel", L.route(F.col("coded"), F.col("coupled")).alias("r")).select("block_id", "channel", "r.*")


@query(f"{WITH} SELECT event_id, len * 11 AS length, len * 11 // 255 + 1 AS segments FROM packets")
def lacing_round_trip(spark, sf_dir: str) -> DataFrame:
    rows = headers(spark, sf_dir).select("event_id", L.lacing(F.col("len") * 11).alias("s"))
    return rows.select("event_id", F.get(L.laced_lengths(F.col("s")), F.lit(0)).cast("long").alias("length"), F.size("s").cast("long").alias("segments"))
