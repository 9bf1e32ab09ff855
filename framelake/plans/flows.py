"""Queries over decisions, chunks of signals and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import layouts as L
from framelake.functions import packets as P
from framelake.functions import pcm as S
from framelake.functions.wire import digits
from framelake.operators import chunks, decisions, intervals, streams
from framelake.plans.base import LOST, SIZE, WITH, query
from framelake.sources import files
from framelake.sources.adapters import FRAME, blocks, headers, packets

#: What a sender knows of each frame.
SENT = f"""{WITH}, sent AS (SELECT stream_id, seq, 6000 + event_id * 7919 % 60000 AS rate, event_id * 31 % 128 AS voice, event_id % 5 / 4.0::DOUBLE AS width, event_id % 3 = 0 AS fec, event_id * 13 % 30 AS loss, event_id % 7 = 0 AS dtx, 1 + event_id * 17 % 200 AS max_bytes, {SIZE} AS samples, event_id % 5 AS bandwidth FROM packets),
    levels AS (SELECT *, 10000 + voice * voice * (floor((1 - width) * 64000 + width * 44000 + 0.5)::BIGINT - 10000) // 16384 AS level, (fec AND loss > (128 - voice) // 16) OR (dtx AND voice > 100) AS wants, max_bytes < (CASE WHEN 48000 // samples > 50 THEN 9000 ELSE 6000 END) * 6 // (6 * 48000 // samples) // 8 OR samples < 480 AS only FROM sent)"""
RIGHT_MODE = "CASE WHEN l.only THEN 2 WHEN l.wants THEN 1 WHEN l.rate >= l.level + CASE {state} WHEN 0 THEN 0 WHEN 1 THEN 4000 ELSE -4000 END THEN 2 ELSE 1 END"
STEP = """list_filter(list_transform(range(CASE WHEN l.loss <= 5 THEN l.bandwidth ELSE 0 END, l.bandwidth + 1), lambda b: CASE WHEN l.rate > ([12000, 14000, 16000, 20000, 22000][b + 1] + CASE WHEN {state} > 0 THEN -1000 ELSE 1000 END) * (125 - least(l.loss, 25)) // 100 THEN b + 1 END), lambda x: x IS NOT NULL)"""


def _sent(spark, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return packets(spark, sf_dir).select(
        "stream_id", "seq", (6000 + e * 7919 % 60000).alias("rate"), (e * 31 % 128).alias("voice"), (e % 5 / 4.0).alias("width"), (e % 3 == 0).alias("fec"), (e * 13 % 30).alias("loss"), (e % 7 == 0).alias("dtx"),
        (1 + e * 17 % 200).alias("max_bytes"), P.frame_samples(F.col("toc")).alias("samples"), (e % 5).alias("bandwidth"),
    )


@query(f"""{SENT.replace("WITH packets", "WITH RECURSIVE packets", 1)}, walk AS (SELECT stream_id, -1::BIGINT AS seq, 0 AS mode, 0 AS copy FROM levels GROUP BY stream_id UNION ALL
    SELECT stream_id, seq, mode, CASE WHEN fec AND loss > 0 AND mode = 1 THEN coalesce(list_max(tried), 0) ELSE 0 END::INT FROM (SELECT l.stream_id, l.seq, l.fec, l.loss, {RIGHT_MODE.format(state="w.mode")} AS mode, {STEP.format(state="w.copy")} AS tried FROM walk w JOIN levels l ON l.stream_id = w.stream_id AND l.seq = w.seq + 1))
    SELECT w.stream_id, w.seq, CASE mode WHEN 1 THEN 'silk' ELSE 'celt' END AS mode, copy > 0 AS copy, CASE WHEN copy > 0 THEN copy - 1 ELSE bandwidth END::INT AS sent_bandwidth FROM walk w JOIN levels l ON w.stream_id = l.stream_id AND w.seq = l.seq""")
def sender_decisions(spark, sf_dir: str) -> DataFrame:
    """Mode and low-rate copy of every frame, each of which hangs on the frame before."""
    return decisions.decide_copies(decisions.decide_modes(_sent(spark, sf_dir))).select("stream_id", "seq", "mode", "copy", "sent_bandwidth")


@query(f"""{WITH}, x AS (SELECT event_id, {SIZE} * (1 + event_id % 3) AS given, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 25 WHEN 2 THEN 200 ELSE 130 END AS wanted, event_id % 6 = 0 AS silk_only FROM packets), y AS (SELECT *, coalesce(wanted * 48000 // 10000, given) AS chosen FROM x)
    SELECT event_id, CASE WHEN chosen <= given AND chosen IN (120, 240, 480, 960, 1920, 2880, 3840, 4800, 5760) AND NOT (silk_only AND chosen < 480) THEN chosen END::BIGINT AS samples, event_id % 40 < 32 AS valid FROM y""")
def frame_sizes(spark, sf_dir: str) -> DataFrame:
    """The frames that inputs of one to three frames are coded in, and whether a configuration exists."""
    e = F.col("event_id")
    given, wanted = P.frame_samples(F.col("toc")) * (1 + e % 3), F.when(e % 4 == 1, 25).when(e % 4 == 2, 200).when(e % 4 == 3, 130)
    return headers(spark, sf_dir).select(e, decisions.frame_size(given, wanted, e % 6 == 0).alias("samples"), decisions.valid_config(e % 40).alias("valid"))


CUT = """c AS (SELECT vec_id % 10 AS signal, vec_id // 10 AS seq, embedding[1:(vec_id * 7 % 64)::INT]::DOUBLE[] AS pcm FROM embeddings), s AS (SELECT signal, seq, unnest(pcm) AS x, unnest(range(len(pcm))) AS i FROM c), n AS (SELECT signal, x, row_number() OVER (PARTITION BY signal ORDER BY seq, i) - 1 AS at_ FROM s)"""


@query(f"WITH {CUT} SELECT signal, at_ // 100 AS frame, 100 AS n, round(sum(x * (at_ % 100 + 1)), 6) AS weighted FROM n GROUP BY signal, at_ // 100")
def signal_frames(spark, sf_dir: str) -> DataFrame:
    """Chunks of 0 to 63 samples cut anew into frames of 100, the last filled up."""
    v = F.col("block_id")
    rows = blocks(spark, sf_dir).select((v % 10).alias("signal"), F.floor(v / 10).alias("seq"), F.slice("pcm", F.lit(1), (v * 7 % 64).cast("int")).alias("pcm"))
    weighted = F.aggregate(F.transform("pcm", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return chunks.frames(rows, "signal", 100).select("signal", "frame", F.size("pcm").alias("n"), F.round(weighted, 6).alias("weighted"))


LONG = """s AS (SELECT vec_id % 5 AS signal, vec_id // 5 AS seq, embedding::DOUBLE[] AS x FROM embeddings), f AS (SELECT signal, flatten(list(x ORDER BY seq)) AS x FROM s GROUP BY signal), p AS (SELECT a.signal, a.x[:least(len(a.x), len(b.x))] AS a, b.x[:least(len(a.x), len(b.x))] AS b FROM f a JOIN f b ON b.signal = (a.signal + 1) % 5),
    k AS (SELECT signal, a, b, unnest([-70, -9, 0, 3, 64, 200]) AS lag FROM p), w AS (SELECT signal, lag, a, b, list_filter(range(len(b)), lambda i: i % 7 <> 0 AND i + lag >= 0 AND i + lag < len(a)) AS i FROM k),
    t AS (SELECT signal, lag, len(i) AS n, list_transform(i, lambda j: a[j + lag + 1]) AS u, list_transform(i, lambda j: b[j + 1]) AS v FROM w)"""


@query(f"""WITH {LONG} SELECT signal, lag::INT AS lag, n, round(list_dot_product(u, v) / sqrt(list_dot_product(u, u) * list_dot_product(v, v)), 6) AS correlation, round(list_distance(u, v) / sqrt(n), 6) AS rmse, round(10 * log10(list_dot_product(u, u) / pow(list_distance(u, v), 2)), 4) AS snr FROM t WHERE n > 0""")
def long_comparison(spark, sf_dir: str) -> DataFrame:
    """Five long signals against each other at six lags, without every seventh place."""
    v = F.col("block_id")
    rows = blocks(spark, sf_dir).select((v % 5).alias("signal"), F.floor(v / 5).alias("seq"), F.col("pcm").alias("a"))
    other = rows.select(((F.col("signal") + 4) % 5).alias("signal"), "seq", F.col("a").alias("b"))
    both = rows.join(other, ["signal", "seq"]).withColumn("_first", F.col("seq") * F.size("a"))
    pairs = both.select("signal", "seq", "a", "b", F.transform("b", lambda _, i: (F.col("_first") + i) % 7 != 0).alias("mask"))
    found = chunks.compared(chunks.lag_sums(pairs, "signal", 128, [-70, -9, 0, 3, 64, 200]))
    return found.select("signal", "lag", "n", F.round("correlation", 6).alias("correlation"), F.round("rmse", 6).alias("rmse"), F.round("snr", 4).alias("snr"))


@query(f"""{LOST}, w AS (SELECT stream_id, event_id, ts48 - event_id % 20 * {FRAME} AS c, ts48 AS d FROM packets WHERE NOT lost AND event_id % 4 = 0 AND event_id % 20 > 0)
    SELECT s.stream_id, s.seq, count(*) AS copies, min(d - s.ts48)::BIGINT AS nearest FROM slots s JOIN w ON w.stream_id = s.stream_id AND w.c < s.ts48 + {FRAME} AND w.d > s.ts48 GROUP BY s.stream_id, s.seq""")
def deep_coverage(spark, sf_dir: str) -> DataFrame:
    """Lost packets within the reach of a deep copy in a packet that came: how many such copies, and how far ahead the nearest is."""
    e = F.col("event_id")
    rows = packets(spark, sf_dir)
    reach = rows.filter(~F.col("lost") & (e % 4 == 0)).select("stream_id", (F.col("ts48") - e % 20 * FRAME).alias("c"), F.col("ts48").alias("d"))
    lost = streams.lost_slots(rows.filter(~F.col("lost"))).select("stream_id", "seq", F.col("ts48").alias("a"), (F.col("ts48") + FRAME).alias("b"))
    return intervals.overlaps(lost, reach, "stream_id", 8 * FRAME).groupBy("stream_id", "seq").agg(F.count("*").alias("copies"), F.min(F.col("d") - F.col("a")).alias("nearest"))


@query(f"""{WITH}, x AS (SELECT event_id, event_id * 37 % 50000 AS back, {SIZE} AS frame, event_id % 30 AS latents, event_id % 960 AS available FROM packets), y AS (SELECT *, (greatest(frame // 480, 1) + 2)::BIGINT AS needed, (back + available) // 480 AS base, 4 * latents - 1 AS last FROM x), z AS (SELECT *, list_transform(range(needed), lambda i: base - i) AS at_ FROM y)
    SELECT event_id, needed, base, len(list_filter(at_, lambda o: o >= 0 AND o <= last)) AS recoverable, len(list_filter(at_, lambda o: o > last AND o >= 0)) AS missing FROM z""")
def feature_windows(spark, sf_dir: str) -> DataFrame:
    """Which features of a deep copy each packet would need, if it were lost, and how many the copy has."""
    e = F.col("event_id")
    window = intervals.feature_window(e * 37 % 50000, P.frame_samples(F.col("toc")), 2, e % 30, e % 960)
    return headers(spark, sf_dir).select(e, window.alias("w")).select("event_id", "w.needed", "w.base", "w.recoverable", "w.missing")


@query(f"""{WITH}, v AS (SELECT stream_id, seq, CASE WHEN lost THEN 0 ELSE len END AS n, CASE WHEN NOT lost THEN md5(event_id::VARCHAR) END AS body FROM packets)
    SELECT stream_id, count(*) AS packets, sum(n)::BIGINT AS bytes, CASE WHEN first(body ORDER BY seq) IS NOT NULL THEN ascii(first(body ORDER BY seq)) END::BIGINT AS first_toc,
    CASE WHEN first(body ORDER BY seq) IS NOT NULL THEN count(*) * (CASE ascii(first(body ORDER BY seq)) // 8 % 4 WHEN 0 THEN 480 WHEN 1 THEN 960 WHEN 2 THEN 1920 ELSE 2880 END) END::BIGINT AS duration FROM v GROUP BY stream_id""")
def vector_summary(spark, sf_dir: str) -> DataFrame:
    """Files of test vectors summed up, by their first packet (all of it begins with a digit of a hash, so that it is silk, or hybrid)."""
    body = F.substring(F.repeat(F.md5(F.col("event_id").cast("string").cast("binary")), 4), F.lit(1), F.col("len").cast("int")).cast("binary")
    rows = packets(spark, sf_dir).select(F.col("stream_id").cast("string").alias("path"), "seq", F.when(~F.col("lost"), body).alias("payload"))
    return files.vector_summary(rows).select(F.col("path").cast("long").alias("stream_id"), "packets", "bytes", "first_toc", "duration")


@query("""WITH v AS (SELECT vec_id, embedding AS x FROM embeddings) SELECT vec_id AS block_id, sha256(unhex(array_to_string(list_transform(list_transform(x, lambda y: round_even(y::DOUBLE * 8388608, 0)::BIGINT), lambda n: printf('%02X%02X%02X', n & 255, (n >> 8) & 255, (n >> 16) & 255)), ''))) AS sha,
    list_sum(list_transform(x, lambda y: round_even(y::DOUBLE * 8388608, 0) / 8388608)) IS NOT NULL AS read, round(list_sum(list_transform(x, lambda y: round_even(y::DOUBLE * 8388608, 0) / 8388608)), 6) AS total FROM v""")
def block_bytes_24(spark, sf_dir: str) -> DataFrame:
    """Blocks as 24-bit bytes: their hash, and the sum of what the integers stand for."""
    whole = S.to_int24(F.col("pcm"))
    data = F.unhex(F.array_join(F.transform(whole, lambda x: digits(F.pmod(x, F.lit(1 << 24)), 3, little=True)), ""))
    total = F.aggregate(S.from_int24(whole), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return blocks(spark, sf_dir).select("block_id", F.sha2(data, 256).alias("sha"), total.isNotNull().alias("read"), F.round(total, 6).alias("total"))


@query("""SELECT vec_id AS block_id, sha256(unhex(array_to_string(list_transform(embedding, lambda y: BITS), ''))) AS sha, round(list_sum(list_transform(embedding, lambda y: y::DOUBLE)), 6) AS total FROM embeddings""".replace("BITS", " || ".join(f"substr(hex(y::FLOAT::BIT::BLOB), {i}, 2)" for i in (7, 5, 3, 1))))
def block_float_bytes(spark, sf_dir: str) -> DataFrame:
    """Blocks as single-precision bytes: their hash, and the sum of what is read from them again."""
    rows = blocks(spark, sf_dir).select("block_id", F.inline(F.array(F.struct(S.float_bytes(F.col("pcm")).alias("data")))))
    total = F.aggregate(S.from_float_bytes(F.col("data")), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("block_id", F.sha2("data", 256).alias("sha"), F.round(total, 6).alias("total"))


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x, label % 4 + 2 AS n FROM embeddings), o AS (SELECT *, unnest(range(n)) AS r FROM p)
    SELECT vec_id AS block_id, r::INT AS channel, len(x) // n AS frames, round(list_sum(list_transform(range(len(x) // n), lambda i: (i + 1) * list_sum(list_transform(range(n), lambda c: ((c * 7 + r * 3) % 11 - 5) * 4096 / 32768.0 * x[i * n + c + 1])))), 6) AS weighted FROM o""")
def projection_frames(spark, sf_dir: str) -> DataFrame:
    """All frames of each block through a square matrix: by channel, the frames' values times their number, added up."""
    n = (F.col("channels") - 1) % 4 + 2
    rows = blocks(spark, sf_dir).select("block_id", "pcm", n.cast("int").alias("n"))
    matrix = F.transform(F.sequence(F.lit(0), F.col("n") * F.col("n") - 1), lambda i: ((F.floor(i / F.col("n")) * 7 + i % F.col("n") * 3) % 11 - 5) * 4096)
    out = rows.select("block_id", "n", F.inline(F.array(F.struct(L.demixed(F.col("pcm"), matrix, F.col("n"), F.col("n")).alias("y")))))
    each = out.select("block_id", "n", F.posexplode("y").alias("at", "value"))
    weight = F.floor(F.col("at") / F.col("n")) + 1
    return each.groupBy("block_id", (F.col("at") % F.col("n")).alias("channel")).agg(F.count("*").alias("frames"), F.round(F.sum(F.col("value") * weight), 6).alias("weighted"))


@query("""WITH l(channels, coupled, mapping) AS (VALUES (1, 0, [0]), (2, 1, [0, 1]), (3, 1, [0, 2, 1]), (4, 2, [0, 1, 2, 3]), (5, 2, [0, 4, 1, 2, 3]), (6, 2, [0, 4, 1, 2, 3, 5]), (7, 3, [0, 4, 1, 2, 3, 5, 6]), (8, 3, [0, 6, 1, 2, 3, 4, 5, 7])),
    p AS (SELECT vec_id, embedding::DOUBLE[] AS x, channels, coupled, mapping, unnest(range(channels * 4)) AS k FROM embeddings JOIN l ON label % 8 + 1 = channels), r AS (SELECT vec_id, k, mapping[k % channels + 1] AS coded, k // channels AS frame, coupled, x FROM p)
    SELECT vec_id AS block_id, round(sum((k + 1) * CASE WHEN coded < 2 * coupled THEN x[(coded // 2 + frame * 2 + coded % 2) % len(x) + 1] ELSE x[(coded - coupled + frame) % len(x) + 1] END), 6) AS weighted FROM r GROUP BY vec_id""")
def mapped_channels(spark, sf_dir: str) -> DataFrame:
    """Four frames of each layout's output channels from its streams, which hold samples of the block from their own number on."""
    rows = blocks(spark, sf_dir).select("block_id", "pcm", L.layout(F.col("channels")).alias("x"))
    at = lambda s, i: F.get("pcm", ((s + i) % F.size("pcm")).cast("int")).cast("double")
    made = F.transform(F.sequence(F.lit(0), F.col("x.streams") - 1), lambda s: F.transform(F.sequence(F.lit(0), F.when(s < F.col("x.coupled"), 7).otherwise(3)), lambda i: at(s, i)))
    out = rows.select("block_id", L.map_channels(made, F.col("x.mapping"), F.col("x.coupled"), F.lit(4)).alias("y"))
    weighted = F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return out.select("block_id", F.round(weighted, 6).alias("weighted"))
