"""Packets taken apart into frames and put together again (RFC 6716, sections 3.2 and appendix B): all four frame codes, padding,
self-delimited packets, several streams in one packet."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from framelake.functions import frames as B
from framelake.functions import packets as P
from framelake.functions.wire import number, part

BINARIES = pa.list_(pa.binary())
PARSED = pa.struct([("toc", pa.int64()), ("sizes", pa.list_(pa.int32())), ("first", pa.int32()), ("padding", pa.int64()), ("used", pa.int32()), ("error", pa.string())])
FRAMED = pa.struct([*PARSED, ("frames", BINARIES)])


def _arrow(type_: pa.DataType, one: Callable) -> Callable:
    """A function of one row's values as one of columns, called in Arrow batches."""

    def batch(*columns: pa.Array) -> pa.Array:
        rows = list(map(one, *[c.to_pylist() for c in columns]))
        if not pa.types.is_struct(type_):
            return pa.array(rows, type_)
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(type_)], fields=list(type_))

    return F.arrow_udf(batch, from_arrow_type(type_))


def _parser(delimited: bool) -> Callable:
    return _arrow(PARSED, lambda d: B.parsed(d, delimited))


def _framer(delimited: bool) -> Callable:
    def one(d: bytes | None) -> tuple:
        p = B.parsed(d, delimited)
        return *p, B.cut(d, p)

    return _arrow(FRAMED, one)


def _builder(delimited: bool, grows: bool) -> Callable:
    if not grows:
        return _arrow(pa.binary(), lambda toc, parts: B.built(toc, parts, delimited))
    return _arrow(pa.binary(), lambda toc, parts, target, tail: None if target is None else B.built(toc, parts, delimited, target, tail))


def _padder() -> Callable:
    return _arrow(pa.struct([("padded", pa.binary()), ("error", pa.string())]), B.padded)


def _barer() -> Callable:
    return _arrow(pa.struct([("bare", pa.binary()), ("error", pa.string())]), B.bare)


def _splitter(streams: int) -> Callable:
    return _arrow(pa.struct([("packets", BINARIES), ("last", pa.int64()), ("error", pa.string())]), lambda d: B.split(d, streams))


def parse(packets: DataFrame, data: str = "payload", delimited: bool = False) -> DataFrame:
    """Add toc, sizes (bytes of each frame), first (place of the first frame), padding, used (bytes of the packet) and error to packets(data).

    A delimited packet says its own length, so more may follow it; any other ends with its data. Where error isn't null, sizes, first
    and used are: `too short` where bytes are missing, `invalid frame count` for none or more than 48, else `invalid packet`. A null is too short."""
    return _beside(packets, _parser(delimited)(data))


def _beside(df: DataFrame, made: Column) -> DataFrame:
    """Add the fields of a struct. A barrier: it is made once, and no filter on it is moved ahead of it."""
    return df.select(*df.columns, F.inline(F.array(made)))


def _settled(df: DataFrame, columns: list[str], *made) -> DataFrame:
    """A barrier: what was made stands as columns, so that neither a filter nor a later step repeats its expressions."""
    return df.select(*columns, F.inline(F.array(F.struct(*made))))


def with_frames(packets: DataFrame, data: str = "payload", delimited: bool = False) -> DataFrame:
    """parse(), with frames (their bytes)."""
    return _beside(packets, _framer(delimited)(data))


def first_frame(data: Column, sizes: Column, first: Column) -> Column:
    """The first frame of a parsed packet; null for a malformed one."""
    return part(data, first, F.get(sizes, F.lit(0)))


def low_rate_copy(parsed: DataFrame, data: str = "payload") -> DataFrame:
    """Add has_copy to what parse() gives: whether the first frame carries a low-rate copy of the frame before. An empty frame carries none."""
    byte = number(first_frame(F.col(data), F.col("sizes"), F.col("first")), F.lit(0))
    return parsed.withColumn("has_copy", F.coalesce(P.first_frame_has_fec(F.col("toc"), byte) & F.col("error").isNull(), F.lit(False)))


def build(toc: Column, parts: Column, delimited: bool = False, target: Column | None = None, tail: Column | None = None) -> Column:
    """The packet of these frames with the shortest frame code; padded to `target` bytes where that is more. Null for no frame, for more
    than 48, where the target is too small, or where a frame whose length is written has more than 1,275 bytes. The padding is zeros, or ends with `tail`, where that holds more than zeros, behind bytes of value 1."""
    toc = toc.cast("long")
    if target is None:
        return _builder(delimited, False)(toc, parts)
    return _builder(delimited, True)(toc, parts, target.cast("long"), F.lit(None).cast("binary") if tail is None else tail)


def padding_of(parsed: DataFrame, data: str = "payload") -> Column:
    """The bytes of padding of what parse() gives, in which extensions stand."""
    return part(F.col(data), F.col("used") - F.col("padding"), F.col("padding"))


def pad(packets: DataFrame, target: Column, data: str = "payload") -> DataFrame:
    """Add padded, the packet grown to `target` bytes, and error, of parse() or `too long` where it is longer already. Extensions in its padding are kept."""
    return _beside(packets, _padder()(F.col(data), target.cast("long")))


def unpad(packets: DataFrame, data: str = "payload") -> DataFrame:
    """Add bare, the packet without padding, and error of parse()."""
    return _beside(packets, _barer()(data))


def regroup(packets: DataFrame, keys: list[str], order: str, data: str = "payload") -> DataFrame:
    """One packet of the frames of each group, in order: keys, toc, joined and error.

    All must agree in all of the first byte but the frame code, and stay within 48 frames and 120 ms; else error says why. A group
    holds 48 packets at most to be valid."""
    rows = with_frames(packets, data).withColumn("error", F.coalesce("error", F.when(F.size("sizes") == 0, "invalid packet")))
    kind = F.shiftright("toc", 2)
    groups = rows.groupBy(keys).agg(
        F.min_by("toc", order).alias("toc"), F.max("error").alias("_bad"), (F.min(kind) != F.max(kind)).alias("_mixed"), F.sum(F.size("sizes")).alias("_m"),
        F.array_sort(F.collect_list(F.struct(order, "frames"))).alias("_rows"),
    )
    groups = groups.withColumn("_frames", F.flatten("_rows.frames"))
    long = (F.col("_m") > P.MOST_FRAMES) | (F.col("_m") * P.frame_samples(F.col("toc")) > P.MOST_SAMPLES)
    groups = groups.withColumn("error", F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(F.col("_mixed"), "different kinds").when(long, "too long"))
    return groups.select(*keys, "toc", F.when(F.col("error").isNull(), build(F.col("toc"), F.col("_frames"))).alias("joined"), "error")


def join_streams(toc: list[Column], parts: list[Column]) -> Column:
    """One packet for several streams: all but the last are delimited."""
    last = len(toc) - 1
    return F.concat(*[build(t, p, delimited=i < last) for i, (t, p) in enumerate(zip(toc, parts))])


def split_streams(packets: DataFrame, streams: int, data: str = "payload") -> DataFrame:
    """Add packets (one for each stream, as it would stand alone) and error to packets(data) that carry this many streams.

    All streams must last equally long, else error is `different durations`."""
    return _beside(packets, _splitter(streams)(data))


def pad_streams(packets: DataFrame, streams: int, target: Column, data: str = "payload") -> DataFrame:
    """Add padded, the packet of this many streams grown to `target` bytes by its last stream, and error."""
    columns = packets.columns
    split = split_streams(packets.withColumn("_whole", target), streams, data).withColumnsRenamed({"error": "_bad", "packets": "_packets", "last": "_begins"})
    rows = split.withColumn("_end", F.when(F.col("_bad").isNull(), F.element_at("_packets", -1)))
    rows = pad(rows, F.greatest(F.lit(0), F.col("_whole") - F.col("_begins")).cast("int"), "_end")
    error = F.coalesce("_bad", "error")
    return rows.select(*columns, F.when(error.isNull(), F.concat(part(F.col(data), F.lit(0), F.col("_begins")), F.col("padded"))).alias("padded"), error.alias("error"))


def unpad_streams(packets: DataFrame, streams: int, data: str = "payload") -> DataFrame:
    """Add bare, the packet of this many streams without the padding of any, and error."""
    columns = packets.columns
    rows = split_streams(packets, streams, data).withColumnsRenamed({"error": "_bad", "packets": "_packets"}).drop("last")
    kept = [*columns, "_bad", "_packets"]
    for k in range(streams):
        parsed = with_frames(rows.withColumn("_one", F.get("_packets", F.lit(k))), "_one")
        own = F.when(F.col("error").isNull(), build(F.col("toc"), F.col("frames"), delimited=k < streams - 1))
        rows = _settled(parsed, kept, *[F.col(f"_bare{i}") for i in range(k)], own.alias(f"_bare{k}"))
    return rows.select(*columns, F.when(F.col("_bad").isNull(), F.concat(*[F.col(f"_bare{k}") for k in range(streams)])).alias("bare"), F.col("_bad").alias("error"))
