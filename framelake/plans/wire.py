"""Queries over packets and pages as bytes. Each builds bytes from rows and takes them apart; the SQL says what must be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import container as C
from framelake.functions import packets as P
from framelake.functions.extensions import by_frame, extension_bytes, extensions_of, found, in_frame_order
from framelake.operators import framing, pages, streams
from framelake.operators.scan import numbered
from framelake.plans.base import SIZE, SLOTS, WITH, query
from framelake.sources import container_files as container_files_source
from framelake.sources.adapters import FRAME, blocks, headers, packets
from framelake.sources.shared import shared_folder, written

#: Frames of each packet: how many, their bytes, and whether all are as long. The toc is that without the code.
FRAMED = f"""{WITH}, framed AS (SELECT event_id, stream_id, seq, event_id * 4 % 256 AS toc, 1 + event_id % 4 AS m, event_id % 4 = 0 OR event_id % 3 = 0 AS same,
    list_transform(range(1 + event_id % 4), lambda i: substr(repeat(md5(event_id || ':' || i), 10), 1, (CASE WHEN event_id % 3 = 0 THEN 5 + event_id % 300 ELSE 1 + (event_id * 7 + i * 13) % 270 END)::INT)) AS frames, lost FROM packets)"""
TEXT = "array_to_string({}, '')"
#: The bytes of each packet without padding.
PLAIN = f"""plain AS (SELECT *, 1 + list_sum(list_transform(frames, lambda x: len(x))) + CASE WHEN m = 1 OR (m = 2 AND same) THEN 0 WHEN m = 2 THEN CASE WHEN len(frames[1]) < 252 THEN 1 ELSE 2 END
    ELSE 1 + CASE WHEN same THEN 0 ELSE list_sum(list_transform(frames[1:m - 1], lambda x: CASE WHEN len(x) < 252 THEN 1 ELSE 2 END)) END END AS bytes FROM framed)"""
TOO_LONG = f"m > 2 AND m * {SIZE} > 5760"


def _frames(e: Column, m: Column) -> Column:
    size = lambda i: F.when(e % 3 == 0, 5 + e % 300).otherwise(1 + (e * 7 + i * 13) % 270)
    name = lambda i: F.concat(e.cast("string"), F.lit(":"), i.cast("string")).cast("binary")
    return F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda i: F.substring(F.repeat(F.md5(name(i)), 10), F.lit(1), size(i).cast("int")).cast("binary"))


def _framed(spark, sf_dir: str, of=headers) -> DataFrame:
    """Packets with their frames."""
    e = F.col("event_id")
    rows = of(spark, sf_dir)
    return rows.select(e, "stream_id", *(["seq"] if "seq" in rows.columns else []), (e * 4 % 256).alias("toc"), _frames(e, 1 + e % 4).alias("parts"))


def _text(parts: str) -> Column:
    return F.md5(F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x)))


@query(f"""{FRAMED}, coded AS (SELECT *, CASE WHEN m = 1 THEN 0 WHEN m = 2 AND same THEN 1 WHEN m = 2 THEN 2 ELSE 3 END AS code, list_sum(list_transform(frames, lambda x: len(x))) AS bytes FROM framed),
    padded AS (SELECT *, event_id % 5 = 1 AS pads, 1 + event_id % 600 - CASE WHEN m < 3 THEN 1 ELSE 0 END AS room FROM coded),
    judged AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN CASE WHEN pads OR code > 1 THEN 'too short' END WHEN {TOO_LONG} THEN 'invalid packet' END AS error FROM padded)
    SELECT event_id, CASE WHEN error IS NULL THEN m END AS frames, CASE WHEN error IS NULL THEN CASE WHEN event_id % 11 = 0 THEN 0 ELSE bytes END END::BIGINT AS bytes,
    CASE WHEN error IS NULL THEN CASE WHEN pads AND room > 0 THEN room - (room - 1) // 255 - 1 ELSE 0 END END::BIGINT AS padding, error FROM judged""")
def packet_parse(spark, sf_dir: str) -> DataFrame:
    """Packets of all frame codes, some padded, some cut short after the first byte."""
    e = F.col("event_id")
    rows = _framed(spark, sf_dir)
    plain = framing.build(F.col("toc"), F.col("parts"))
    rows = rows.select(e, F.inline(F.array(F.struct("toc", "parts", plain.alias("plain")))))
    wide = framing.build(F.col("toc"), F.col("parts"), target=F.octet_length("plain") + 1 + e % 600)
    rows = rows.select(e, F.when(e % 5 == 1, wide).otherwise(F.col("plain")).alias("payload"))
    parsed = framing.parse(rows.select(e, F.when(e % 11 == 0, F.substring("payload", 1, 1)).otherwise(F.col("payload")).alias("payload")))
    good = F.col("error").isNull()
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    return parsed.select("event_id", F.when(good, F.size("sizes")).cast("long").alias("frames"), F.when(good, total).alias("bytes"), F.when(good, F.col("padding")).cast("long").alias("padding"), "error")


@query(f"""{FRAMED} SELECT event_id, i::INT AS pos, len(frames[i + 1])::INT AS bytes, frames[i + 1] AS frame FROM (SELECT *, unnest(range(m)) AS i FROM framed WHERE NOT ({TOO_LONG}))""")
def frame_explode(spark, sf_dir: str) -> DataFrame:
    rows = _framed(spark, sf_dir).select("event_id", framing.build(F.col("toc"), F.col("parts")).alias("payload"))
    found = framing.with_frames(rows).filter("error is null").select("event_id", F.posexplode("frames").alias("pos", "frame"))
    return found.select("event_id", "pos", F.octet_length("frame").alias("bytes"), F.col("frame").cast("string").alias("frame"))


COPIES = f"""first AS (SELECT *, ascii(frames[1]) AS b, greatest(1, {SIZE} // 960) AS n FROM framed),
    low AS (SELECT event_id, stream_id, seq, lost, toc < 128 AND NOT ({TOO_LONG}) AND ((b >> (7 - n)::INT) & 1 = 1 OR (toc % 8 >= 4 AND (b >> greatest(0, 6 - 2 * n)::INT) & 1 = 1)) AS has_copy FROM first)"""


@query(f"{FRAMED}, {COPIES} SELECT event_id, has_copy FROM low")
def low_rate_copies(spark, sf_dir: str) -> DataFrame:
    """Whether a packet carries a low-rate copy of the one before, by the first byte of its first frame; false for a malformed one."""
    rows = _framed(spark, sf_dir).select("event_id", framing.build(F.col("toc"), F.col("parts")).alias("payload"))
    return framing.low_rate_copy(framing.parse(rows)).select("event_id", "has_copy")


@query(f"""{FRAMED}, rows AS (SELECT stream_id, seq // 2 AS part, seq, CASE WHEN stream_id % 7 = 0 THEN toc ELSE stream_id * 8 % 256 END AS toc, m, frames FROM framed),
    groups AS (SELECT stream_id, part, arg_min(toc, seq) AS toc, min(toc // 4) <> max(toc // 4) AS mixed, sum(m) AS m, string_agg({TEXT.format("frames")}, '' ORDER BY seq) AS body, bool_or({TOO_LONG}) AS bad FROM rows GROUP BY stream_id, part),
    judged AS (SELECT *, CASE WHEN bad THEN 'invalid packet' WHEN mixed THEN 'different kinds' WHEN m > 48 OR m * {SIZE} > 5760 THEN 'too long' END AS error FROM groups)
    SELECT stream_id, part, error, CASE WHEN error IS NULL THEN m END::BIGINT AS frames, CASE WHEN error IS NULL THEN md5(body) END AS body FROM judged""")
def joined_packets(spark, sf_dir: str) -> DataFrame:
    """Every two packets of a stream put into one, which is taken apart again."""
    toc = F.when(F.col("stream_id") % 7 == 0, F.col("toc")).otherwise(F.col("stream_id") * 8 % 256)
    rows = _framed(spark, sf_dir, packets).select("stream_id", F.floor(F.col("seq") / 2).alias("part"), "seq", framing.build(toc, F.col("parts")).alias("payload"))
    joined = framing.regroup(rows, ["stream_id", "part"], "seq").select("stream_id", "part", "error", "joined")
    again = framing.with_frames(joined.withColumnRenamed("error", "_error"), "joined").withColumn("error", F.col("_error"))
    return again.select("stream_id", "part", "error", F.when(F.col("error").isNull(), F.size("frames")).cast("long").alias("frames"), F.when(F.col("error").isNull(), _text("frames")).alias("body"))


@query(f"""{FRAMED}, {PLAIN}, judged AS (SELECT *, {TOO_LONG} AS bad FROM plain)
    SELECT event_id, CASE WHEN NOT bad THEN bytes + event_id % 700 END::BIGINT AS padded, CASE WHEN NOT bad THEN bytes END::BIGINT AS bare, CASE WHEN NOT bad THEN md5({TEXT.format("frames")}) END AS body FROM judged""")
def padded_packets(spark, sf_dir: str) -> DataFrame:
    """Packets padded by up to 699 bytes, and without the padding again."""
    rows = _framed(spark, sf_dir).select("event_id", F.inline(F.array(F.struct(framing.build(F.col("toc"), F.col("parts")).alias("payload")))))
    grown = framing.pad(rows, F.octet_length("payload") + F.col("event_id") % 700).select("event_id", "padded")
    bare = framing.unpad(grown, "padded").select("event_id", F.octet_length("padded").cast("long").alias("padded"), "bare")
    again = framing.with_frames(bare, "bare")
    good = F.col("error").isNull()
    return again.select("event_id", "padded", F.octet_length("bare").cast("long").alias("bare"), F.when(good, _text("frames")).alias("body"))


#: Extensions of each packet: in each frame up to two with ids and lengths that frames share, so that they are repeated, and in every fifth packet one more.
EXTENDED = """e AS (SELECT event_id, 1 + event_id % 4 AS m, event_id % 3 AS k FROM events), x AS (SELECT event_id, m, f, j, 3 + (event_id * 5 + j * 40) % 125 AS id FROM e, LATERAL (SELECT unnest(range(m)) AS f), LATERAL (SELECT unnest(range(k)) AS j)
    UNION ALL SELECT event_id, m, m - 1, 9, 100 FROM e WHERE event_id % 5 = 0), d AS (SELECT *, substr(repeat(md5(event_id || '/' || f || '/' || j), 10), 1, (CASE WHEN id < 32 THEN (event_id + j) % 2 ELSE (event_id * 31 + j * 7 + f * 13) % 300 END)::INT) AS data FROM x)"""


@query(f"""WITH {EXTENDED} SELECT event_id, count(*) AS n, count(*) FILTER (WHERE f = m - 1) AS in_last, md5(string_agg(f || ':' || id || ':' || data, ',' ORDER BY f, j)) AS listed, min(f) FILTER (WHERE id = 100)::INT AS first_100 FROM d GROUP BY event_id""")
def extension_round_trip(spark, sf_dir: str) -> DataFrame:
    """Extensions put into the padding of packets, which are padded further, and listed again: how many, how many in the last frame, all in frame order, and the frame of the
    first with the id 100."""
    e = F.col("event_id")
    m, upto = 1 + e % 4, lambda n: F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def one(f: Column, j: Column, id_: Column) -> Column:
        n = F.when(id_ < 32, (e + j) % 2).otherwise((e * 31 + j * 7 + f * 13) % 300).cast("int")
        name = F.md5(F.concat_ws("/", e.cast("string"), f.cast("string"), j.cast("string")).cast("binary"))
        return F.struct(id_.cast("int").alias("id"), f.cast("int").alias("frame"), F.substring(F.repeat(name, F.lit(10)), F.lit(1), n).cast("binary").alias("data"))

    shared = F.flatten(F.transform(upto(m), lambda f: F.transform(upto(e % 3), lambda j: one(f, j, 3 + (e * 5 + j * 40) % 125))))
    more = F.when(e % 5 == 0, F.array(one(m - 1, F.lit(9), F.lit(100)))).otherwise(F.slice(shared, F.lit(1), F.lit(0)))
    rows = headers(spark, sf_dir).select(e, m.cast("int").alias("m"), F.inline(F.array(F.struct(F.concat(shared, more).alias("x"))))).filter(F.size("x") > 0)
    rows = rows.withColumn("padding", extension_bytes("x", "m"))
    frames = F.transform(upto(F.col("m")), lambda i: F.md5(i.cast("string").cast("binary")).cast("binary"))
    plain = rows.select(e, "m", "padding", frames.alias("parts"), (128 + e * 8 % 128).alias("toc"))
    least = F.octet_length("padding") + 32 * F.col("m") + 2
    made = plain.select(e, "m", F.inline(F.array(F.struct(framing.build(F.col("toc"), F.col("parts"), target=(least + F.floor(F.octet_length("padding") / 254) + 3).cast("int"), tail=F.col("padding")).alias("payload")))))
    grown = framing.pad(made, F.octet_length("payload") + F.col("event_id") % 300).select(e, "m", F.col("padded").alias("payload"))
    parsed = framing.parse(grown).filter("error is null")
    listed = extensions_of(parsed.select(e, "m", framing.padding_of(parsed).alias("padding")), F.col("padding"), F.col("m")).filter("id is not null").drop("padding")
    listed = written(listed, "extensions")  # read three times
    text = F.transform("extensions", lambda x: F.concat_ws(":", x["frame"].cast("string"), x["id"].cast("string"), x["data"].cast("string")))
    counts = by_frame(listed, ["event_id", "m"]).groupBy("event_id").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("frame") == F.col("m") - 1, F.col("n"))), F.lit(0)).alias("in_last"))
    ordered = in_frame_order(listed, ["event_id"]).select("event_id", F.md5(F.array_join(text, ",").cast("binary")).alias("listed"))
    return counts.join(ordered, "event_id").join(found(listed, ["event_id"], 100).select("event_id", F.col("frame").alias("first_100")), "event_id", "left")


@query(f"""{FRAMED}, rows AS (SELECT event_id, toc, unnest([0, 1, 2]) AS stream, event_id % 5 = 1 AS uneven, md5(event_id || '/0') AS a, md5(event_id || '/1') AS b, md5(event_id || '/2') AS c FROM framed)
    SELECT event_id, CASE WHEN NOT uneven THEN stream END AS stream, CASE WHEN NOT uneven THEN CASE stream WHEN 0 THEN a || a WHEN 1 THEN b || b ELSE c || c END END AS body, CASE WHEN uneven THEN 'different durations' END AS error
    FROM rows WHERE NOT uneven OR stream = 0""")
def stream_split(spark, sf_dir: str) -> DataFrame:
    """Three streams in one packet, two of them delimited, and each stream's packet again; where one has fewer frames, an error."""
    e, toc = F.col("event_id"), F.col("event_id") * 4 % 256
    name = lambda k: F.md5(F.concat(e.cast("string"), F.lit(f"/{k}")).cast("binary")).cast("binary")
    two = [F.array(name(k), name(k)) for k in range(3)]
    two[2] = F.when(e % 5 == 1, F.array(name(2))).otherwise(two[2])
    rows = headers(spark, sf_dir).select(e, F.inline(F.array(F.struct(framing.join_streams([toc] * 3, two).alias("payload")))))
    split = framing.split_streams(rows, 3).select(e, "error", F.posexplode_outer("packets").alias("stream", "packet"))
    return framing.with_frames(split.withColumnRenamed("error", "_error"), "packet").select(
        e, "stream", F.when(F.col("_error").isNull(), F.aggregate("frames", F.lit(b""), lambda s, x: F.concat(s, x)).cast("string")).alias("body"), F.col("_error").alias("error"),
    )


@query(f"""{FRAMED}, {PLAIN}, {COPIES}, {SLOTS}, carried AS (SELECT r.stream_id, p.seq, row_number() OVER (PARTITION BY r.stream_id, r.seq ORDER BY p.seq DESC) AS n FROM plain r JOIN plain p ON r.stream_id = p.stream_id AND p.seq BETWEEN r.seq - 5 AND r.seq - 1
    WHERE NOT r.lost AND p.bytes <= 1023 AND p.event_id % 2 = 1), copies AS (SELECT DISTINCT stream_id, seq FROM carried WHERE n <= 2), after AS (SELECT stream_id, seq - 1 AS seq, has_copy FROM low WHERE NOT lost)
    SELECT s.*, CASE WHEN c.seq IS NOT NULL THEN 'redundant' WHEN coalesce(has_copy, false) AND ago = 1 THEN 'low rate' ELSE 'concealed' END AS kind
    FROM slots s LEFT JOIN copies c ON s.stream_id = c.stream_id AND s.seq = c.seq LEFT JOIN after a ON s.stream_id = a.stream_id AND s.seq = a.seq""")
def recovery_cascade(spark, sf_dir: str) -> DataFrame:
    """How each lost packet is made up for, by the copies that the packets after it really carry; every second one is padded and too long for that."""
    e, own = F.col("event_id"), ("stream_id", "seq", F.col("ts48").alias("ts"), "lost")
    made = packets(spark, sf_dir).select(*own, e, F.inline(F.array(F.struct((e * 4 % 256).alias("toc"), _frames(e, 1 + e % 4).alias("parts")))))
    sent = made.select("stream_id", "seq", "ts", "lost", e, "toc", "parts", F.inline(F.array(F.struct(framing.build(F.col("toc"), F.col("parts")).alias("plain")))))
    wide = framing.build(F.col("toc"), F.col("parts"), target=F.greatest(F.octet_length("plain"), F.lit(1100)))
    return streams.recovery(sent.select("stream_id", "seq", "ts", "lost", F.when(e % 2 == 0, wide).otherwise(F.col("plain")).alias("payload")))


@query(f"""{WITH} SELECT stream_id AS serial, seq + 2 AS page_seq, md5(repeat(md5(event_id::VARCHAR), len::INT // 4 + 1)) AS payload, (sum(CASE WHEN lost THEN 0 ELSE {FRAME} END) OVER (PARTITION BY stream_id ORDER BY seq))::BIGINT AS granule FROM packets""")
def page_round_trip(spark, sf_dir: str) -> DataFrame:
    """Streams written as pages with checksums, read, checked and taken apart into packets again."""
    body = F.repeat(F.md5(F.col("event_id").cast("string").cast("binary")), (F.floor(F.col("len") / 4) + 1).cast("int")).cast("binary")
    rows = packets(spark, sf_dir).select("stream_id", "seq", F.when(F.col("lost"), 0).otherwise(FRAME).alias("samples"), body.alias("payload"))
    number = lambda n: F.lit(n).cast("long")
    heads = rows.select("stream_id").distinct().select("stream_id", C.head(number(2), number(312), number(48_000), number(0), number(0)).alias("head"), C.tags(F.lit("framelake"), F.array().cast("array<string>")).alias("tags"))
    read = written(pages.read_pages(pages.write_pages(rows, heads).select("page")).filter("error is null").drop("page"), "pages")  # read three times
    found = pages.packets_of_pages(read).filter("last_page > 1").withColumnRenamed("last_page", "page_seq")
    return found.join(read.select("serial", "page_seq", "granule"), ["serial", "page_seq"]).select("serial", "page_seq", F.md5("payload").alias("payload"), F.col("granule").cast("long").alias("granule"))


BUNDLED = f"""SELECT user_id % 8 AS serial, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS seq, repeat(md5(event_id::VARCHAR), CASE WHEN event_id % 499 = 0 THEN 2200 + event_id % 2000 ELSE 1 + event_id % 4 END::INT) AS body,
    CASE WHEN event_id % 13 = 0 THEN 0 ELSE {FRAME} END AS samples FROM events"""


@query(f"""WITH rows AS ({BUNDLED}) SELECT serial, seq, md5(body) AS payload, len(body) AS bytes, (sum(samples) OVER (PARTITION BY serial ORDER BY seq))::BIGINT AS granule, 2 AS channels, 'framelake' AS vendor FROM rows""")
def container_files(spark, sf_dir: str) -> DataFrame:
    """Eight streams written to files, one each, whose packets of up to 134 kB go over several pages; and read in splits of 64 kB."""
    e = F.col("event_id")
    times = F.when(e % 499 == 0, 2200 + e % 2000).otherwise(1 + e % 4).cast("int")
    rows = headers(spark, sf_dir).select((F.col("stream_id") % 8).alias("stream_id"), e, F.when(F.col("lost"), 0).otherwise(FRAME).alias("samples"), F.repeat(F.md5(e.cast("string").cast("binary")), times).cast("binary").alias("payload"))
    rows = numbered(rows, "stream_id", ["event_id"], e)
    number = lambda n: F.lit(n).cast("long")
    heads = rows.select("stream_id").distinct().select("stream_id", C.head(number(2), number(312), number(48_000), number(0), number(0)).alias("head"), C.tags(F.lit("framelake"), F.array().cast("array<string>")).alias("tags"))
    name, path = container_files_source.register(spark), shared_folder(spark, "container")
    dealt = pages.write_pages(rows, heads).repartition("stream_id").sortWithinPartitions("stream_id", "page_seq")
    dealt.write.format(name).mode("append").save(path)
    read = spark.read.format(name).option("splitBytes", 1 << 16).load(path)
    found = numbered(pages.packet_granules(read), "serial", ["at", "place"], F.col("at"))
    opened = pages.open_streams(read).filter("error is null").select(F.col("serial").alias("_serial"), F.col("head.channels").cast("int").alias("channels"), "tags.vendor")
    rows = found.filter("seq > 1").join(opened, F.col("serial") == F.col("_serial"))
    return rows.select("serial", (F.col("seq") - 2).alias("seq"), F.md5("payload").alias("payload"), F.octet_length("payload").cast("long").alias("bytes"), F.col("granule").cast("long").alias("granule"), "channels", "vendor")


@query("""WITH h AS (SELECT vec_id AS stream_id, label % 8 + 1 AS channels, vec_id % 65536 AS pre_skip, 8000 + vec_id * 48000 AS rate, vec_id * 37 % 60000 - 30000 AS gain, CASE WHEN label % 8 + 1 <= 2 THEN vec_id % 2 ELSE vec_id % 3 END AS family FROM embeddings),
    l(channels, streams, coupled) AS (VALUES (1, 1, 0), (2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 3, 2), (6, 4, 2), (7, 4, 3), (8, 5, 3)),
    judged AS (SELECT *, (channels <= 2 OR family <> 0) AND rate BETWEEN 0 AND 4294967295 AS valid FROM h JOIN l USING (channels))
    SELECT stream_id, valid, CASE WHEN valid THEN pre_skip END AS pre_skip, CASE WHEN valid THEN rate END AS rate, CASE WHEN valid THEN gain END AS gain,
    CASE WHEN valid THEN streams END AS streams, CASE WHEN valid THEN coupled END AS coupled, 'v' || stream_id AS vendor, 'last=' || stream_id AS title FROM judged""")
def stream_headers(spark, sf_dir: str) -> DataFrame:
    """Both headers of a stream, written and read again; more than two channels can't be of family 0, and a rate above 32 bits has no header."""
    v, channels = F.col("block_id"), F.col("channels").cast("long")
    family = F.when(channels <= 2, v % 2).otherwise(v % 3)
    comments = F.array(F.lit("TITLE=first"), F.lit("nothing"), F.concat(F.lit("TITLE=last="), v.cast("string")))
    wrote = blocks(spark, sf_dir).select(v.alias("stream_id"), C.head(channels, v % 65536, 8000 + v * 48000, v * 37 % 60000 - 30000, family).alias("head"), C.tags(F.concat(F.lit("v"), v.cast("string")), comments).alias("tags"))
    read = wrote.select("stream_id", F.inline(F.array(F.struct(C.read_head(F.col("head")).alias("h"), C.read_tags(F.col("tags")).alias("t")))))
    return read.select("stream_id", F.col("h").isNotNull().alias("valid"), "h.pre_skip", "h.rate", "h.gain", F.col("h.streams").cast("int").alias("streams"), F.col("h.coupled").cast("int").alias("coupled"), "t.vendor", F.col("t.comments")["TITLE"].alias("title"))
