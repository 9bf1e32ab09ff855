"""Container pages: cut out of files, put together from packets, and the packets in them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import container as C
from framelake.functions import packets as P
from framelake.functions.wire import let, number, part
from framelake.operators.scan import joined, running
from framelake.sources.shared import written

PAGES = "path string, at long, page binary"


def cut_pages(files: DataFrame) -> DataFrame:
    """files(path, content), as the binaryFile source reads them, to path, at (place of the page in the file) and page, up to the first
    place where no whole page begins. A file is read by one task; its pages are spread over all others."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, at, content = [], 0, content or b""
                while content[at : at + 4] == C.PAGE.encode() and at + C.HEADER_BYTES <= len(content):
                    body = at + C.HEADER_BYTES + content[at + 26]
                    end = body + sum(content[at + C.HEADER_BYTES : body])
                    if end > len(content):
                        break
                    rows.append((path, at, content[at:end]))
                    at = end
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], names=["path", "at", "page"])

    return files.select("path", "content").mapInArrow(cut, PAGES)


def read_pages(pages: DataFrame) -> DataFrame:
    """Add flags, granule, serial, page_seq, continued, segments, payload and error to pages(page): `invalid page` or `wrong checksum`, or null."""
    p = F.col("page")
    size, at = F.octet_length(p), lambda i, n=1: number(p, F.lit(i), n, little=True)
    n = at(26).cast("int")
    segments = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: number(p, i + C.HEADER_BYTES).cast("int"))).otherwise(F.array().cast("array<int>"))
    granule = at(6, 7) + number(p, F.lit(13)).cast("decimal(20,0)") * F.lit(1 << 56).cast("decimal(20,0)")
    fields = F.struct(at(5).alias("flags"), granule.cast("decimal(20,0)").alias("granule"), at(14, 4).alias("serial"), at(18, 4).alias("page_seq"), at(22, 4).alias("_crc"), segments.alias("segments"))
    rows = pages.select(*pages.columns, F.inline(F.array(fields)))
    body = F.aggregate("segments", F.lit(0), lambda s, x: s + x)
    whole = (size >= C.HEADER_BYTES) & (part(p, F.lit(0), F.lit(4)) == F.lit(C.PAGE.encode())) & (size >= C.HEADER_BYTES + F.size("segments") + body)
    exact = part(p, F.lit(0), C.HEADER_BYTES + F.size("segments") + body)
    error = F.when(~F.coalesce(whole, F.lit(False)), "invalid page").when(let(exact, lambda x: C.crc(C.unsealed(x))) != F.col("_crc"), "wrong checksum")
    payload = part(p, C.HEADER_BYTES + F.size("segments"), body)
    made = F.struct(F.col("flags").bitwiseAND(C.CONTINUED).cast("boolean").alias("continued"), payload.alias("payload"), error.alias("error"))
    return rows.select(*pages.columns, "flags", "granule", "serial", "page_seq", "segments", F.inline(F.array(made)))


def write_pages(packets: DataFrame, heads: DataFrame) -> DataFrame:
    """packets(stream_id, seq, samples, payload) and heads(stream_id, head, tags) to stream_id, page_seq and page: pages for each of the two
    headers, for each packet with the samples up to and with it as its granule, and an empty one that ends the stream.

    A packet stands on a page of its own, one above 65,024 bytes on several, of which all but the last have no granule (all ones). Streams are
    numbered by their id modulo 2^32."""
    long = lambda n: F.lit(n).cast("long")
    rows = running(packets, "stream_id", "seq", sums={"_upto": F.col("samples"), "_place": long(1)})
    body = rows.select("stream_id", (F.col("_place") + 1).alias("_place"), F.lit(0).alias("flags"), F.coalesce("_upto", F.lit(0)).alias("granule"), "payload")
    first = heads.select("stream_id", F.inline(F.array(*[F.struct(long(i).alias("_place"), F.lit(flags).alias("flags"), long(0).alias("granule"), F.col(c).alias("payload")) for i, flags, c in ((0, C.FIRST, "head"), (1, 0, "tags"))])))
    count = packets.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("samples").alias("granule"))
    last = joined(heads.select("stream_id"), count, ["stream_id"]).select("stream_id", (F.coalesce("n", F.lit(0)) + 2).alias("_place"), F.lit(C.LAST).alias("flags"), F.coalesce("granule", F.lit(0)).alias("granule"), F.lit(b"").alias("payload"))
    rows = written(body.unionByName(first).unionByName(last), "page-parts")
    rows = running(rows.withColumn("_pages", F.floor(F.floor(F.octet_length("payload") / 255) / C.PAGE_SEGMENTS) + 1), "stream_id", "_place", sums={"_until": F.col("_pages")})
    rows = rows.select("stream_id", "_place", "_until", "_pages", "flags", "granule", F.inline(C.page_parts(F.col("payload"), F.col("flags") == C.LAST)))
    flags = F.when(F.col("k") > 0, C.CONTINUED).otherwise(0) + F.when((F.col("flags") == C.FIRST) & (F.col("k") > 0), 0).otherwise(F.col("flags"))
    granule = F.when(F.col("goes_on") & (F.col("_place") > 1), -1).otherwise(F.col("granule"))
    page_seq = F.col("_until") - F.col("_pages") + F.col("k")
    page = C.bare_page(F.col("segments"), F.col("bytes"), flags, granule, F.pmod("stream_id", F.lit(1 << 32)), page_seq)
    rows = rows.select("stream_id", page_seq.alias("page_seq"), F.inline(F.array(F.struct(page.alias("page")))))
    return rows.select("stream_id", "page_seq", C.sealed(F.col("page")).alias("page"))


def packets_of_pages(pages: DataFrame) -> DataFrame:
    """pages(serial, page_seq, continued, segments array<int>, payload) to serial, packet (ascending, with gaps), last_page and payload.

    A packet ends with its first segment below 255, on a later page if need be. Dropped are a packet that never ends, one that the next
    page does not continue, a continuation of nothing, and empty packets."""
    segment = F.posexplode("segments").alias("at", "size")
    before = F.aggregate(F.slice("segments", F.lit(1), F.col("at")), F.lit(0), lambda s, x: s + x)
    cut = pages.select("serial", "page_seq", "continued", "segments", "payload", segment)
    cut = cut.select("serial", "page_seq", "at", "continued", "size", F.substring("payload", before + 1, F.col("size")).alias("body"))
    order, number_ = ["page_seq", "at"], F.col("page_seq") * 256 + F.col("at")
    rows = running(cut, "serial", order, before={"_size": F.col("size")}, at=number_)
    open_ = F.coalesce(F.col("_size") == 255, F.lit(False))
    fresh = (F.col("at") == 0) & ~F.col("continued")
    rows = written(rows.withColumn("orphan", (F.col("at") == 0) & F.col("continued") & ~open_).withColumn("_fresh", (fresh | ~open_).cast("long")).drop("_size"), "segments")
    rows = running(rows, "serial", order, sums={"packet": F.col("_fresh")}, at=number_)
    whole = rows.groupBy("serial", "packet").agg(
        F.max("orphan").alias("orphan"), F.max_by("size", F.struct("page_seq", "at")).alias("end"), F.max("page_seq").alias("last_page"), F.array_sort(F.collect_list(F.struct("page_seq", "at", "body"))).alias("parts"),
    )
    body = F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["body"]))
    return whole.filter(~F.col("orphan") & (F.col("end") < 255)).select("serial", "packet", "last_page", body.alias("payload")).filter(F.octet_length("payload") > 0)


def packet_granules(packets: DataFrame) -> DataFrame:
    """The packets that the container source reads with their own granules: that of the page less the durations of the packets that end after it there, 0
    at least; that of the page where one of those has no duration. Rows with an error and empty packets are left out afterwards.

    A page has 255 packets at most, so its window is bounded."""
    toc, second = number(F.col("payload"), F.lit(0)), number(F.col("payload"), F.lit(1))
    n = P.frames_lenient(toc, second)
    span = F.when(n.between(1, P.MOST_FRAMES), n * P.frame_samples(toc)).cast("decimal(20,0)")
    rows = packets.filter("error is null").withColumn("_span", span)
    behind = Window.partitionBy("path", "serial", "at").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0).cast("decimal(20,0)")
    less = F.when(F.count_if(F.col("_span").isNull()).over(behind) > 0, zero).otherwise(F.coalesce(F.sum("_span").over(behind), zero))
    exact = F.greatest(zero, F.col("granule") - less).cast("decimal(20,0)")
    return rows.withColumn("granule", exact).drop("_span", "error").filter(F.octet_length("payload") > 0)


def open_streams(packets: DataFrame) -> DataFrame:
    """Of what the container source reads, by path and serial: head and tags, as read_head() and read_tags() give them, and error: `invalid page` where the first
    packet isn't on a stream's first page, `invalid header` where one of the two packets isn't its header, or null."""
    order = Window.partitionBy("path", "serial").orderBy("at", "place")
    two = packets.filter("error is null").withColumn("_n", F.row_number().over(order)).filter("_n <= 2")
    nth = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    rows = two.groupBy("path", "serial").agg(nth(1, "payload").alias("_head"), nth(2, "payload").alias("_tags"), nth(1, "flags").alias("_flags"))
    rows = rows.select("path", "serial", "_flags", C.read_head(F.col("_head")).alias("head"), C.read_tags(F.col("_tags")).alias("tags"))
    error = F.when(F.col("_flags").bitwiseAND(C.FIRST) == 0, "invalid page").when(F.col("head").isNull() | F.col("tags").isNull(), "invalid header")
    return rows.select("path", "serial", "head", "tags", error.alias("error"))
