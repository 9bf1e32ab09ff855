"""Redundant payloads (RFC 2198): earlier frames carried in later packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.wire import number
from framelake.operators.scan import running, with_before

MOST_BLOCKS, MOST_OFFSET, MOST_LENGTH = 5, 0x3FFF, 0x3FF


def add_redundancy(packets: DataFrame, depth: int, frame: int, payload_type: int) -> DataFrame:
    """Add wire, the payload with up to `depth` earlier ones, to packets(stream_id, seq, ts, payload).

    Of the last five payloads of the stream the newest that fit are carried, oldest first: at most 1023 bytes, and a whole number of
    frames but at most 16383 ticks back. A null or empty payload stays as it is."""
    rows = running(packets, "stream_id", "seq", sums={"_place": F.lit(1).cast("long")})
    kept = with_before(rows, "stream_id", "_place", MOST_BLOCKS, F.struct("ts", "payload"), "_past").drop("_place")
    ago = lambda x: F.pmod(F.col("ts") - x["ts"], F.lit(1 << 32))
    size = lambda x: F.octet_length(x["payload"])
    fits = lambda x: (ago(x) > 0) & (ago(x) <= MOST_OFFSET) & (ago(x) % frame == 0) & (size(x) > 0) & (size(x) <= MOST_LENGTH)
    kept = kept.withColumn("_past", F.filter("_past", fits))
    n = F.least(F.size("_past"), F.lit(min(depth, MOST_BLOCKS)))
    kept = kept.withColumn("_past", F.slice("_past", F.size("_past") - n + 1, n))
    head = lambda x: F.lpad(F.hex(F.lit((128 | payload_type) << 24) + ago(x) * 1024 + size(x)), 8, "0")
    heads = F.array_join(F.concat(F.transform("_past", head), F.array(F.lit(f"{payload_type:02X}"))), "")
    bodies = F.array_join(F.transform("_past", lambda x: F.hex(x["payload"])), "")
    wire = F.unhex(F.concat(heads, bodies, F.hex("payload")))
    return kept.withColumn("wire", F.when((F.octet_length("payload") > 0) & F.lit(depth > 0), wire).otherwise(F.col("payload"))).drop("_past")


def split_redundancy(packets: DataFrame, payload_type: int) -> DataFrame:
    """Add primary, blocks (offset and payload of each, oldest first) and error to packets(wire). Where error isn't null, the others are."""
    wire, size = F.col("wire"), F.coalesce(F.octet_length("wire"), F.lit(0))

    def verdict(i: Column) -> Column:
        """Null where the header at this place is that of a block."""
        first, rest = number(wire, 4 * i), number(wire, 4 * i + 1, 3)
        primary = F.when(first % 128 != payload_type, "unexpected primary type").otherwise("end")
        return (
            F.when(size == 0, "empty payload").when(4 * i >= size, "truncated header").when(first < 128, primary).when(4 * i + 4 > size, "truncated redundant header")
            .when((F.floor(rest / 1024) == 0) | (rest % 1024 == 0), "invalid redundant block").when(first % 128 != payload_type, "unexpected redundant type").when(i == MOST_BLOCKS, "too many blocks")
        )

    out = packets.withColumn("_v", F.transform(F.sequence(F.lit(0), F.lit(MOST_BLOCKS)), verdict))
    out = out.withColumn("_n", (F.array_position(F.transform("_v", lambda v: v.isNotNull()), True) - 1).cast("int")).withColumn("_v", F.get("_v", F.col("_n")))
    heads = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: number(wire, 4 * i + 1, 3))
    out = out.withColumn("_h", F.when(F.col("_n") > 0, heads).otherwise(F.array().cast("array<bigint>")))
    # a barrier: a filter on what follows must not be pushed below the headers, where it would hold each step's expression many times over
    out = out.select(*packets.columns, F.inline(F.array(F.struct("_n", F.col("_v").alias("_verdict"), "_h"))))
    upto = lambda k: F.aggregate(F.slice("_h", F.lit(1), k), 4 * F.col("_n").cast("long") + 1, lambda s, h: s + h % 1024)
    out = out.withColumn("_body", upto(F.size("_h")))
    late = F.when(F.col("_verdict") != "end", F.col("_verdict")).when(F.col("_body") > size, "truncated redundant payload").when(F.col("_body") == size, "missing primary")
    block = lambda h, i: F.struct(F.floor(h / 1024).alias("offset"), F.substring(wire, (upto(i) + 1).cast("int"), (h % 1024).cast("int")).alias("payload"))
    good = late.isNull()
    made = F.struct(late.alias("error"), F.when(good, F.transform("_h", block)).alias("blocks"), F.when(good, F.substring(wire, (F.col("_body") + 1).cast("int"), size)).alias("primary"))
    return out.select(*packets.columns, F.inline(F.array(made)))
