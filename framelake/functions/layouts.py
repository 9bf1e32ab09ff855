"""Channel layouts of multi-stream packets, and container lacing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values (RFC 7845, mapping family 1): channels to streams, coupled streams, and the coded channel of each output channel.
LAYOUTS = {
    1: (1, 0, [0]),
    2: (1, 1, [0, 1]),
    3: (2, 1, [0, 2, 1]),
    4: (2, 2, [0, 1, 2, 3]),
    5: (3, 2, [0, 4, 1, 2, 3]),
    6: (4, 2, [0, 4, 1, 2, 3, 5]),
    7: (4, 3, [0, 4, 1, 2, 3, 5, 6]),
    8: (5, 3, [0, 6, 1, 2, 3, 4, 5, 7]),
}
SILENT = 255


def layout(channels: Column) -> Column:
    """Struct of streams, coupled and mapping; null for other counts than 1 to 8."""
    found = F.lit(None).cast("struct<streams: int, coupled: int, mapping: array<int>>")
    for n, (streams, coupled, mapping) in LAYOUTS.items():
        row = F.struct(F.lit(streams).alias("streams"), F.lit(coupled).alias("coupled"), F.array(*map(F.lit, mapping)).alias("mapping"))
        found = F.when(channels == n, row).otherwise(found)
    return found


def route(coded: Column, coupled: Column) -> Column:
    """Struct of the stream and its side (0 or 1) that a coded channel comes from; coupled streams come first. Null for a silent one."""
    paired = coded < 2 * coupled
    stream = F.when(paired, F.floor(coded / 2)).otherwise(coded - coupled)
    return F.when(coded != SILENT, F.struct(stream.cast("int").alias("stream"), F.when(paired, coded % 2).otherwise(0).alias("side")))


def map_channels(streams: Column, mapping: Column, coupled: Column, samples: Column) -> Column:
    """Interleaved output of decoded streams (an array of sample arrays, coupled ones interleaved); what has no source is 0."""
    routes = F.transform(mapping, lambda c: route(c, coupled))

    def sample(i: Column) -> Column:
        r = F.get(routes, i % F.size(mapping))
        at = F.floor(i / F.size(mapping)) * F.when(r["stream"] < coupled, 2).otherwise(1) + r["side"]
        return F.coalesce(F.get(F.get(streams, r["stream"]), at.cast("int")), F.lit(0.0))

    n = samples * F.size(mapping)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), sample)).otherwise(F.array().cast("array<double>"))


def lacing(length: Column) -> Column:
    """Segment lengths of a packet: as many of 255 as go, then the rest, which may be 0."""
    return F.concat(F.array_repeat(F.lit(255), F.floor(length / 255).cast("int")), F.array((length % 255).cast("int")))


def laced_lengths(segments: Column) -> Column:
    """Lengths of the packets that end within a page's segments; an open one at the end is left out."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("open"))

    def step(s: Column, x: Column) -> Column:
        total = s["open"] + x
        return F.struct(F.when(x < 255, F.concat(s["out"], F.array(total))).otherwise(s["out"]).alias("out"), F.when(x < 255, 0).otherwise(total).alias("open"))

    return F.aggregate(segments, start, step, lambda s: s["out"])


def ambisonics(channels: Column, paired: bool = False) -> Column:
    """Struct of order, extra (0, or 2 for a stereo track beside the field), streams and coupled, for (order + 1)^2 + extra channels up to 227;
    null for other counts. paired: all channels are in pairs, for a matrix to mix, which orders 1 to 5 have."""
    root = F.floor(F.sqrt(channels)).cast("int")
    extra = (channels - root * root).cast("int")
    streams, coupled = (F.floor((channels + 1) / 2), F.floor(channels / 2)) if paired else (root * root + F.floor(extra / 2), F.floor(extra / 2))
    good = (channels >= 1) & (channels <= 227) & extra.isin(0, 2)
    good = good & root.between(2, 6) if paired else good
    return F.when(good, F.struct((root - 1).alias("order"), extra.alias("extra"), streams.cast("int").alias("streams"), coupled.cast("int").alias("coupled")))


def demix(coded: Column, matrix: Column, rows: Column, columns: Column) -> Column:
    """One frame of output channels from coded ones, by a matrix of 16-bit integers stored column by column."""
    cell = lambda r, c: F.get(matrix, c * rows + r) / 32768 * F.get(coded, c)
    across = F.sequence(F.lit(0), (columns - 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), (rows - 1).cast("int")), lambda r: F.aggregate(across, F.lit(0.0), lambda s, c: s + cell(r, c)))


def demixed(coded: Column, matrix: Column, rows: Column, columns: Column) -> Column:
    """All frames of interleaved output channels from interleaved coded ones, by such a matrix; a frame that isn't whole is left out."""
    n = F.floor(F.size(coded) / columns).cast("int")
    frame = lambda i: demix(F.slice(coded, i * columns + 1, columns), matrix, rows, columns)
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), frame))).otherwise(F.array().cast("array<double>"))


def demixed_int16(coded: Column, matrix: Column, rows: Column, columns: Column) -> Column:
    """The same of 16-bit integers: sums of products rounded at 15 bits, halves up, and clamped."""
    whole = demixed(F.transform(coded, lambda x: x.cast("double")), matrix, rows, columns)
    return F.transform(whole, lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(x + 0.5))).cast("int"))


def stream_rates(bitrate: Column, streams: Column, coupled: Column, low: Column, frames: int = 50) -> Column:
    """Bits a second of each stream of a surround packet, of `frames` packets a second: low is the stream with the low-frequency channel,
    or -1. A coupled stream weighs twice a single one and the low-frequency one an eighth; all get 500 at least. Whole numbers, cut towards 0."""
    div = lambda a, b: F.when((a < 0) != (b < 0), -F.floor(F.abs(a) / F.abs(b))).otherwise(F.floor(F.abs(a) / F.abs(b)))
    lows = (low >= 0).cast("long")
    single = F.greatest(F.lit(0), streams - coupled - lows)
    normal, each = 2 * coupled + single, 40 * max(50, frames)
    own = F.when(low >= 0, F.least(F.floor(bitrate / 20), F.lit(3000)) + 15 * max(50, frames)).otherwise(0)
    ahead = F.greatest(F.lit(0), F.least(F.lit(20000), div(div(bitrate - each * normal - own * lows, normal), F.lit(2))))
    share = div(256 * (bitrate - own * lows - ahead * (coupled + single) - each * normal), F.greatest(F.lit(1), single * 256 + 512 * coupled + 32 * lows))

    def rate(i: Column) -> Column:
        paired, alone, bass = 2 * each + F.greatest(F.lit(0), ahead + share * 2), each + F.greatest(F.lit(0), ahead + share), F.greatest(F.lit(0), own + F.floor(share / 8))
        return F.greatest(F.lit(500), F.when(i < coupled, paired).when(i != low, alone).otherwise(bass)).cast("long")

    even = F.greatest(F.lit(500), F.floor(bitrate / streams)).cast("long")
    return F.transform(F.sequence(F.lit(0), (streams - 1).cast("int")), lambda i: F.when(normal > 0, rate(i)).otherwise(even))
