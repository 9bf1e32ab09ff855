"""Queries over signals, layouts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import layouts as L
from framelake.functions import packets as P
from framelake.functions import pcm as S
from framelake.functions.packets import ERRORS
from framelake.functions.wire import digits
from framelake.operators import reports, streams
from framelake.operators.scan import running
from framelake.plans.base import MODE, WITH, query
from framelake.sources import files
from framelake.sources.adapters import blocks, headers, packets

TWO = "WITH p AS (SELECT a.vec_id AS block_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def _neighbours(spark, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir)
    return rows.select("block_id", F.col("pcm").alias("a")).join(rows.select((F.col("block_id") - 1).alias("block_id"), F.col("pcm").alias("b")), "block_id")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-32767, least(32767, round_even(x::DOUBLE * 32768 * 4, 0)))::INT) AS x FROM embeddings)
    SELECT vec_id AS block_id, list_sum(x)::BIGINT AS total, sha256(unhex(array_to_string(list_transform(x, lambda n: printf('%02X%02X', n & 255, (n >> 8) & 255)), ''))) AS sha FROM v""")
def block_bytes(spark, sf_dir: str) -> DataFrame:
    """Blocks as 16-bit bytes: their hash, and the sum of what is read from them again."""
    loud = F.transform("pcm", lambda x: x.cast("double") * 4)
    rows = blocks(spark, sf_dir).select("block_id", F.inline(F.array(F.struct(S.to_bytes(S.to_symmetric_int16(loud)).alias("data")))))
    return rows.select("block_id", F.aggregate(S.from_bytes(F.col("data")), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.sha2("data", 256).alias("sha"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT vec_id, x, list_transform(range(len(x) // 2), lambda i: (x[2 * i + 1] + x[2 * i + 2]) / 2) AS mono, list_max(list_transform(x, lambda y: abs(y))) AS peak FROM v)
    SELECT vec_id AS block_id, round(list_sum(mono), 6) AS mono, round(list_sum(x) * cos((vec_id % 5 / 2.0) * pi() / 4), 6) AS "left", round(list_sum(x) * sin((vec_id % 5 / 2.0) * pi() / 4), 6) AS "right",
    round(CASE WHEN peak > 0.25 THEN list_sum(x) * 0.25 / peak ELSE list_sum(x) END, 6) AS scaled FROM m""")
def block_mixdown(spark, sf_dir: str) -> DataFrame:
    """Sums over the mean of two channels, over both sides of a panned block, and over a block without peaks."""
    p = F.col("pcm")
    panned = S.pan(p, F.col("block_id") % 5 / 2.0 - 1)
    return blocks(spark, sf_dir).select(
        "block_id", F.round(_total(S.downmix(p, 2)), 6).alias("mono"), F.round(_total(S.channel(panned, 2, 0)), 6).alias("left"), F.round(_total(S.channel(panned, 2, 1)), 6).alias("right"), F.round(_total(S.normalize_peak(p, 0.25)), 6).alias("scaled"),
    )


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), r AS (SELECT vec_id, list_transform(range(greatest(1, round(len(x) * 2 / 3.0)::INT)), lambda i: CASE WHEN floor(i * 1.5::DOUBLE)::INT >= len(x) - 1 THEN x[len(x)]
    ELSE x[floor(i * 1.5::DOUBLE)::INT + 1] + (x[floor(i * 1.5::DOUBLE)::INT + 2] - x[floor(i * 1.5::DOUBLE)::INT + 1]) * (i * 1.5::DOUBLE - floor(i * 1.5::DOUBLE)) END) AS y FROM v) SELECT vec_id AS block_id, len(y)::INT AS n, round(list_sum(y), 6) AS total FROM r""")
def block_resample(spark, sf_dir: str) -> DataFrame:
    y = S.resample(F.col("pcm"), 48_000, 32_000)
    return blocks(spark, sf_dir).select("block_id", F.size(y).alias("n"), F.round(_total(y), 6).alias("total"))


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda x: x * x) AS b FROM embeddings), n AS (SELECT *, len(a) AS n FROM p)
    SELECT vec_id AS block_id, round(list_sum(list_transform(range(n), lambda i: (1 - pow(sin((i + 0.5) / n * pi() / 2), 2)) * a[i + 1] + pow(sin((i + 0.5) / n * pi() / 2), 2) * b[i + 1])), 6) AS faded,
    round(list_sum(list_transform(a, lambda x: round_even(x * 32768, 0) / 32768)), 6) AS rounded, len(list_filter(range(n), lambda i: i >= list_min(list_filter(range(n), lambda k: abs(a[k + 1]) > 0.15)) - 2 AND i <= list_max(list_filter(range(n), lambda k: abs(a[k + 1]) > 0.15)) + 2))::INT AS loud FROM n""")
def block_edits(spark, sf_dir: str) -> DataFrame:
    """Sums over a cross-fade from a block to its squares and over 16-bit samples read back, and the length without quiet head and tail."""
    p = F.transform("pcm", lambda x: x.cast("double"))
    faded = S.cross_fade(p, F.transform("pcm", lambda x: x.cast("double") * x.cast("double")))
    trimmed = F.when(F.exists(p, lambda x: F.abs(x) > 0.15), F.size(S.trim_silence(p, 0.15, 2))).otherwise(0)
    return blocks(spark, sf_dir).select("block_id", F.round(_total(faded), 6).alias("faded"), F.round(_total(S.from_int16(S.to_int16(p))), 6).alias("rounded"), trimmed.alias("loud"))


@query("""WITH c AS (SELECT vec_id AS block_id, vec_id % 240 AS n FROM embeddings), r AS (SELECT *, floor(sqrt(n))::INT AS root, n - floor(sqrt(n))::INT * floor(sqrt(n))::INT AS extra FROM c), g AS (SELECT *, n BETWEEN 1 AND 227 AND extra IN (0, 2) AS good FROM r)
    SELECT block_id, CASE WHEN good THEN root - 1 END AS "order", CASE WHEN good THEN root * root + extra // 2 END::INT AS streams, CASE WHEN good THEN extra // 2 END::INT AS coupled, CASE WHEN good AND root BETWEEN 2 AND 6 THEN (n + 1) // 2 END::INT AS paired FROM g""")
def ambisonic_layouts(spark, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).select("block_id", (F.col("block_id") % 240).alias("n"))
    return rows.select("block_id", L.ambisonics(F.col("n")).alias("x"), L.ambisonics(F.col("n"), paired=True)["streams"].alias("paired")).select("block_id", "x.order", "x.streams", "x.coupled", "paired")


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x, label % 4 + 2 AS n FROM embeddings), o AS (SELECT *, unnest(range(n)) AS r FROM p)
    SELECT vec_id AS block_id, r::INT AS channel, round(list_sum(list_transform(range(n), lambda c: ((c * 7 + r * 3) % 11 - 5) * 4096 / 32768.0 * x[c + 1])), 6) AS value FROM o""")
def projection_demix(spark, sf_dir: str) -> DataFrame:
    """The first frame of each block through a square matrix."""
    n = (F.col("channels") - 1) % 4 + 2
    rows = blocks(spark, sf_dir).select("block_id", "pcm", F.when(F.lit(True), n).cast("int").alias("n"))
    matrix = F.transform(F.sequence(F.lit(0), F.col("n") * F.col("n") - 1), lambda i: ((F.floor(i / F.col("n")) * 7 + i % F.col("n") * 3) % 11 - 5) * 4096)
    out = rows.select("block_id", F.posexplode(L.demix(F.col("pcm"), matrix, F.col("n"), F.col("n"))).alias("channel", "value"))
    return out.select("block_id", "channel", F.round("value", 6).alias("value"))


LOW = "CASE WHEN streams > 2 THEN streams - 1 ELSE -1 END"
RATES = f"""WITH l(streams, coupled) AS (VALUES (1, 0), (1, 1), (2, 1), (2, 2), (3, 2), (4, 2), (4, 3), (5, 3)), b AS (SELECT DISTINCT vec_id % 50 * 4000 + 3000 AS bitrate FROM embeddings),
    x AS (SELECT *, {LOW} AS low, CASE WHEN {LOW} >= 0 THEN 1 ELSE 0 END AS lows FROM l, b), y AS (SELECT *, greatest(0, streams - coupled - lows) AS single, CASE WHEN lows = 1 THEN least(bitrate // 20, 3000) + 750 ELSE 0 END AS own FROM x),
    z AS (SELECT *, 2 * coupled + single AS normal FROM y), w AS (SELECT *, greatest(0, least(20000, trunc(trunc((bitrate - 2000 * normal - own * lows) / normal::DOUBLE) / 2)))::BIGINT AS ahead FROM z),
    v AS (SELECT *, trunc(256 * (bitrate - own * lows - ahead * (coupled + single) - 2000 * normal) / greatest(1, single * 256 + 512 * coupled + 32 * lows)::DOUBLE)::BIGINT AS share FROM w), u AS (SELECT *, unnest(range(streams)) AS stream FROM v)"""


@query(f"""{RATES} SELECT streams, coupled, bitrate, stream::INT AS stream, greatest(500, CASE WHEN stream < coupled THEN 4000 + greatest(0, ahead + share * 2) WHEN stream <> low THEN 2000 + greatest(0, ahead + share)
    ELSE greatest(0, own + floor(share / 8.0)) END)::BIGINT AS rate FROM u""")
def stream_rates(spark, sf_dir: str) -> DataFrame:
    """Bits a second of each stream of every layout, at the bitrates that the blocks ask for."""
    bitrates = blocks(spark, sf_dir).select((F.col("block_id") % 50 * 4000 + 3000).alias("bitrate")).distinct()
    layouts = [F.struct(F.lit(s).alias("streams"), F.lit(c).alias("coupled")) for s, c, _ in L.LAYOUTS.values()]
    rows = bitrates.select("bitrate", F.inline(F.array(*layouts)))
    low = F.when(F.col("streams") > 2, F.col("streams") - 1).otherwise(-1)
    return rows.select("streams", "coupled", "bitrate", F.posexplode(L.stream_rates(F.col("bitrate"), F.col("streams"), F.col("coupled"), low)).alias("stream", "rate"))


@query(f"""{TWO}, l AS (SELECT block_id, unnest([0, 1, 2, 5, 9]) AS lag, a, b FROM p), k AS (SELECT *, list_filter(range(len(a) - lag), lambda i: i % 7 <> 0) AS places FROM l)
    SELECT block_id, lag::INT AS lag, round(list_sum(list_transform(places, lambda i: a[i + lag + 1] * b[i + 1])) / sqrt(list_sum(list_transform(places, lambda i: a[i + lag + 1] * a[i + lag + 1])) * list_sum(list_transform(places, lambda i: b[i + 1] * b[i + 1]))), 5) + 0::DOUBLE AS correlation FROM k""")
def lag_correlation(spark, sf_dir: str) -> DataFrame:
    rows = _neighbours(spark, sf_dir).withColumn("lag", F.explode(F.array(*map(F.lit, (0, 1, 2, 5, 9)))))
    return rows.select("block_id", "lag", (F.round(reports.correlation_at(F.col("a"), F.col("b"), F.col("lag"), skip=7), 5) + F.lit(0.0)).alias("correlation"))


CORRELATED = """list_sum(list_transform(range(len(a) - abs(d)), lambda i: a[i + greatest(d, 0) + 1] * b[i + greatest(-d, 0) + 1])) / sqrt(list_sum(list_transform(range(len(a) - abs(d)), lambda i: pow(a[i + greatest(d, 0) + 1], 2))) *
    list_sum(list_transform(range(len(a) - abs(d)), lambda i: pow(b[i + greatest(-d, 0) + 1], 2))))"""


@query(f"""{TWO}, coarse AS (SELECT block_id, a, b, unnest(range(-12, 13, 4)) AS d FROM p), c AS (SELECT block_id, arg_max(d, {CORRELATED}) AS d0 FROM coarse GROUP BY block_id),
    fine AS (SELECT p.*, unnest(range(greatest(-12, d0 - 4), least(12, d0 + 4) + 1)) AS d FROM p JOIN c USING (block_id)), f AS (SELECT block_id, d, {CORRELATED} AS r FROM fine)
    SELECT block_id, arg_max(d, r)::INT AS delay, round(max(r), 5) AS correlation FROM f GROUP BY block_id""")
def best_delay(spark, sf_dir: str) -> DataFrame:
    return reports.best_delay(_neighbours(spark, sf_dir), 12, 4).select("block_id", "delay", F.round("correlation", 5).alias("correlation"))


@query(f"""{TWO}, s AS (SELECT block_id, sqrt(list_sum(list_transform(list_zip(a, b), lambda t: pow(t[1] - t[2], 2))) / len(a)) AS e, sqrt(list_dot_product(b, b) / list_dot_product(a, a)) AS ratio, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS c FROM p)
    SELECT block_id, round(100 * (1 - 0.5 * ln(1 + e) / ln(1.13)), 4) AS q, concat_ws(',', CASE WHEN 100 * (1 - 0.5 * ln(1 + e) / ln(1.13)) < 35 THEN 'q' END, CASE WHEN c < 0.1 THEN 'correlation' END, CASE WHEN ratio < 0.9 THEN 'quiet' END, CASE WHEN ratio > 1.1 THEN 'loud' END) AS failed FROM s""")
def quality_bars(spark, sf_dir: str) -> DataFrame:
    """Quality of each block as a copy of the one before, and the limits that it misses."""
    d = lambda f: F.aggregate(F.zip_with("a", "b", lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    rows = _neighbours(spark, sf_dir).select("block_id", F.size("a").alias("n"), d(lambda x, y: (x - y) * (x - y)).alias("dd"), d(lambda x, y: x * x).alias("aa"), d(lambda x, y: y * y).alias("bb"), d(lambda x, y: x * y).alias("ab"))
    q, ratio, c = reports.quality(F.sqrt(F.col("dd") / F.col("n"))), F.sqrt(F.col("bb") / F.col("aa")), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))
    return rows.select("block_id", F.round(q, 4).alias("q"), F.array_join(reports.failed_bars(q, c, ratio, 35, 0.1, 0.9, 1.1), ",").alias("failed"))


@query(f"""{WITH}, m AS (SELECT {MODE} AS mode, median(len) AS median FROM packets GROUP BY ALL), g(mode, most) AS (VALUES ('silk', 50.0::DOUBLE), ('hybrid', 200.0::DOUBLE), ('celt', 10.0::DOUBLE), ('lossless', 1.0::DOUBLE))
    SELECT mode, median, most, CASE WHEN median IS NULL THEN 'missing' ELSE 'above' END AS why FROM g LEFT JOIN m USING (mode) WHERE median IS NULL OR median > most""")
def guard_violations(spark, sf_dir: str) -> DataFrame:
    """Modes whose median length is above its guard, or that have none."""
    guards = spark.createDataFrame([("silk", 50.0), ("hybrid", 200.0), ("celt", 10.0), ("lossless", 1.0)], "mode string, most double")
    return reports.violations(headers(spark, sf_dir).select(P.mode(F.col("toc")).alias("mode"), "len"), guards, "mode", "len", "most")


@query(f"""{WITH}, s AS (SELECT stream_id, avg(len) - 60 AS gap, count(*) FILTER (WHERE toc % 4 = 0) > 10 AS has_gap, min(value) AS least FROM packets GROUP BY stream_id)
    SELECT round(avg(gap) FILTER (WHERE has_gap), 6) AS mean_gap, round(avg(gap) FILTER (WHERE has_gap) + min(least) / 1000, 6) AS score, (SELECT stream_id FROM s ORDER BY gap, stream_id LIMIT 1) AS worst FROM s""")
def gap_report(spark, sf_dir: str) -> DataFrame:
    """The mean gap over streams that have one, a score of it and the least value, and the stream with the least gap."""
    rows = packets(spark, sf_dir).groupBy("stream_id").agg((F.avg("len") - 60).alias("gap"), (F.count_if(F.col("toc") % 4 == 0) > 10).alias("has_gap"), F.min("value").alias("least"))
    gap = F.avg(F.when(F.col("has_gap"), F.col("gap")))
    return rows.agg(F.round(gap, 6).alias("mean_gap"), F.round(gap + F.min("least") / 1000, 6).alias("score"), F.min_by("stream_id", F.struct("gap", "stream_id")).alias("worst"))


@query(f"""{WITH}, s AS (SELECT stream_id, count(*) AS n, count_if(lost) AS lost, count_if(lost AND len <= 60) AS red, count_if(lost AND len > 60 AND toc < 128) AS fec, count_if(lost AND len > 60 AND toc >= 128) AS concealed, count_if(toc = 255) AS errors FROM packets GROUP BY stream_id)
    SELECT stream_id, round(least(100, least(40, 100.0 * lost / n * 1.2) + least(30, 100.0 * fec / greatest(lost, 1) * 0.3) + least(15, red * 0.5) + least(15, fec * 0.5) + least(15, concealed * 20 / 120.0) + CASE WHEN errors = 0 THEN 10 ELSE 0 END))::INT AS score FROM s""")
def resilience_scores(spark, sf_dir: str) -> DataFrame:
    """How well each stream makes up for its losses, if short packets have copies and the low-rate kinds carry the one before."""
    lost, small, low = F.col("lost"), F.col("len") <= 60, F.col("toc") < 128
    n = lambda c, name: F.count_if(c).alias(name)
    rows = headers(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("n"), n(lost, "lost"), n(lost & small, "red"), n(lost & ~small & low, "fec"), n(lost & ~small & ~low, "concealed"), n(F.col("toc") == 255, "errors"))
    deep = 100.0 * F.col("fec") / F.greatest(F.col("lost"), F.lit(1))
    return rows.select("stream_id", reports.resilience(100.0 * F.col("lost") / F.col("n"), deep, F.col("red"), F.col("fec"), F.col("concealed") * 20, F.col("errors")).alias("score"))


@query(f"""{WITH}, w AS (SELECT stream_id, seq, list(len::DOUBLE) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS l FROM packets)
    SELECT stream_id, seq, round(list_reduce(l, lambda s, x: s * 0.65 + x * 0.35), 6) AS smooth FROM w""")
def smoothed_lengths(spark, sf_dir: str) -> DataFrame:
    return reports.smoothed(packets(spark, sf_dir), "stream_id", "seq", "len", "smooth").select("stream_id", "seq", F.round("smooth", 6).alias("smooth"))


CHUNKS = """SELECT event_id, toc < 96 AS silk, event_id * 7 % 3000 AS n, event_id * 7 % 3000 % 960 AS r1 FROM packets"""


@query(f"""{WITH}, c AS ({CHUNKS}), d AS (SELECT *, CASE WHEN r1 > 480 THEN r1 - 480 ELSE r1 END AS r2 FROM c), e AS (SELECT *, NOT silk AND r2 > 240 AND r2 < 480 AS splits FROM d), k AS (SELECT event_id,
    list_filter(list_concat(list_transform(range(n // 960), lambda i: 960), [CASE WHEN r1 > 480 THEN 480 END, CASE WHEN splits THEN 240 END, CASE WHEN splits THEN r2 - 240 WHEN r2 > 0 THEN r2 END]), lambda x: x IS NOT NULL) AS chunks FROM e)
    SELECT event_id, coalesce(array_to_string(chunks, ','), '') AS chunks FROM k""")
def concealed_chunks(spark, sf_dir: str) -> DataFrame:
    """Steps in which losses of up to 3000 samples are concealed."""
    rows = headers(spark, sf_dir)
    return rows.select("event_id", F.array_join(S.concealed_chunks(F.col("event_id") * 7 % 3000, F.col("toc") < 96), ",").alias("chunks"))


TEXTS = " ".join(f"WHEN {-i} THEN '{t}'" for i, t in enumerate(ERRORS))


@query(f"""{WITH} SELECT event_id, CASE WHEN event_id % 9 = 0 THEN -1 ELSE toc // 8 END::INT AS config, CASE WHEN event_id % 2 = 0 THEN 120 ELSE 312 END::BIGINT AS lookahead, CASE (2 - event_id % 12) {TEXTS} ELSE 'unknown error' END AS text FROM packets""")
def packet_settings(spark, sf_dir: str) -> DataFrame:
    """The configuration found again by its properties (one of them wrong in every ninth packet), the lookahead, and the text of a code."""
    toc, e = F.col("toc"), F.col("event_id")
    config = P.find_config(P.mode(toc), P.bandwidth(toc), P.frame_samples(toc) + F.when(e % 9 == 0, 1).otherwise(0))
    return headers(spark, sf_dir).select("event_id", config.alias("config"), P.lookahead(F.lit(48_000), e % 2 == 0).alias("lookahead"), P.error_text((2 - e % 12).cast("int")).alias("text"))


@query(f"""{WITH}, t AS (SELECT stream_id, event_id, greatest(0, least(200, seq + event_id * 13 % 7 - 3)) AS tick, seq FROM packets)
    SELECT stream_id, event_id, tick, row_number() OVER (PARTITION BY stream_id ORDER BY tick, seq) AS place FROM t""")
def arrival_schedule(spark, sf_dir: str) -> DataFrame:
    """Packets by the tick at which they arrive, early or late by up to three, in their order where ticks are equal."""
    tick = F.greatest(F.lit(0), F.least(F.lit(200), F.col("seq") + F.col("event_id") * 13 % 7 - 3))
    rows = packets(spark, sf_dir).select("stream_id", "event_id", tick.alias("tick"), "seq")
    placed = running(rows, "stream_id", ["tick", "seq"], sums={"place": F.lit(1).cast("long")}, at=F.col("tick"))
    return placed.select("stream_id", "event_id", "tick", "place")


@query(f"""{WITH}, a AS (SELECT stream_id, seq, event_id % 40 = 0 AS active FROM packets), g AS (SELECT *, sum(CASE WHEN active THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) AS era FROM a),
    r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, era ORDER BY seq) - CASE WHEN era > 0 THEN 1 ELSE 0 END AS idle FROM g)
    SELECT stream_id, seq, idle, idle > 10 AND idle % 21 <> 10 AS suppressed FROM r""")
def silence_suppression(spark, sf_dir: str) -> DataFrame:
    """Frames that need not be sent, if every fortieth event is active."""
    rows = packets(spark, sf_dir).select("stream_id", "seq", (F.col("event_id") % 40 == 0).alias("active"))
    return streams.silence_suppressed(rows).select("stream_id", "seq", "idle", "suppressed")


@query(f"""{WITH} SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1 AS seq, event_id * 2654435761 % 4294967296 AS final_range, CASE WHEN NOT lost THEN md5(substr(repeat(md5(event_id::VARCHAR), 4), 1, len)) END AS payload FROM packets""")
def vector_files(spark, sf_dir: str) -> DataFrame:
    """Each stream as a file of test vectors, and its records again."""
    big = lambda n: digits(n, 4)
    body = F.substring(F.repeat(F.md5(F.col("event_id").cast("string").cast("binary")), 4), F.lit(1), F.col("len").cast("int")).cast("binary")
    rows = packets(spark, sf_dir).select("stream_id", "seq", "event_id", F.when(F.col("lost"), F.lit(b"")).otherwise(body).alias("body"))
    record = F.unhex(F.concat(big(F.octet_length("body")), big(F.col("event_id") * 2654435761 % 4294967296), F.hex("body")))
    listed = rows.select("stream_id", "seq", record.alias("record")).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "record"))).alias("x"))
    content = F.unhex(F.array_join(F.transform("x.record", lambda r: F.hex(r)), ""))
    found = files.vectors(listed.select(F.col("stream_id").cast("string").alias("path"), content.alias("content")))
    return found.select(F.col("path").cast("long").alias("stream_id"), "seq", "final_range", F.md5("payload").alias("payload"))


@query("""SELECT vec_id AS block_id, label % 8 + 1 AS channels, 8000 + vec_id AS rate, len(embedding)::INT AS n, list_sum(list_transform(embedding, lambda x: round_even(x::DOUBLE * 32768, 0)::INT))::BIGINT AS total FROM embeddings""")
def wav_files(spark, sf_dir: str) -> DataFrame:
    """Each block as a file of 16-bit samples, and read again."""
    v = F.col("block_id")
    made = blocks(spark, sf_dir).select(v.cast("string").alias("path"), files.to_wav(S.to_int16(F.col("pcm")), F.col("channels"), 8000 + v).alias("content"))
    total = F.aggregate("pcm", F.lit(0).cast("long"), lambda s, x: s + x)
    return files.wav(made).select(F.col("path").cast("long").alias("block_id"), F.col("channels").cast("int").alias("channels"), "rate", F.size("pcm").alias("n"), total.alias("total"))
