"""Columns of packet headers (RFC 6716, section 3). A toc is the first byte, 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.wire import number

MOST_FRAMES, MOST_SAMPLES = 48, 5760  # 120 ms at 48 kHz


def config(toc: Column) -> Column:
    return F.shiftright(toc, 3)


def stereo(toc: Column) -> Column:
    return toc.bitwiseAND(4) != 0


def code(toc: Column) -> Column:
    return toc.bitwiseAND(3)


def build_toc(config: Column, stereo: Column, code: Column) -> Column:
    return config.bitwiseAND(31) * 8 + F.when(stereo, 4).otherwise(0) + code.bitwiseAND(3)


def mode(toc: Column) -> Column:
    return F.when(toc < 96, "silk").when(toc < 128, "hybrid").otherwise("celt")


def bandwidth(toc: Column) -> Column:
    c = config(toc)
    low = F.when(c < 4, "narrow").when(c < 8, "medium").when(c < 12, "wide").when(c < 14, "superwide").when(c < 16, "full")
    return low.when(c < 20, "narrow").when(c < 24, "wide").when(c < 28, "superwide").otherwise("full")


def frame_samples(toc: Column, rate: int = 48_000) -> Column:
    """Samples of one frame: silk has 10 to 60 ms, hybrid 10 or 20 ms, celt 2.5 to 20 ms."""
    c = config(toc)
    silk = F.when(c % 4 == 3, F.lit(rate * 60 // 1000)).otherwise(F.floor(rate * F.pow(F.lit(2), c % 4) / 100))
    hybrid = F.when(c % 2 == 1, F.lit(rate // 50)).otherwise(F.lit(rate // 100))
    celt = F.floor(rate * F.pow(F.lit(2), c % 4) / 400)
    return F.when(c < 12, silk).when(c < 16, hybrid).otherwise(celt).cast("long")


def frames_lenient(toc: Column, second_byte: Column) -> Column:
    """Frames a packet says it has; null where the count byte is missing."""
    return F.when(code(toc) == 0, F.lit(1)).when(code(toc) < 3, F.lit(2)).otherwise(second_byte.bitwiseAND(63)).cast("long")


def frames_strict(toc: Column, second_byte: Column) -> Column:
    """The same, but null for no frame, more than 48, or more than 120 ms."""
    n = frames_lenient(toc, second_byte)
    return F.when((n >= 1) & (n <= MOST_FRAMES) & (n * frame_samples(toc) <= MOST_SAMPLES), n)


def packet_samples(toc: Column, second_byte: Column, rate: int = 48_000) -> Column:
    """Samples of a packet at a rate; null where it can't have that many frames or lasts more than 120 ms."""
    n = frames_lenient(toc, second_byte) * frame_samples(toc, rate)
    return F.when(n.between(1, rate * 120 // 1000), n)


def mode_label(data: Column) -> Column:
    """The mode of a packet's bytes; `empty` for none."""
    toc = number(data, F.lit(0))
    return F.when(toc.isNull(), "empty").otherwise(mode(toc))


def first_frame_has_fec(toc: Column, first_byte: Column) -> Column:
    """Whether the first frame of a silk or hybrid packet carries a low-rate copy of the frame before: the bit after the voice bits,
    one for each 20 ms; the second channel's bits follow the first's."""
    n = F.greatest(F.lit(1), F.floor(frame_samples(toc) / 960))
    bit = lambda at: F.floor(first_byte / F.pow(F.lit(2), at)) % 2 == 1
    return F.when(mode(toc) == "celt", F.lit(False)).otherwise(bit(7 - n) | (stereo(toc) & bit(6 - 2 * n)))


def segments(length: Column) -> Column:
    """Lacing values that a container page needs for a packet; one more where the length is a multiple of 255."""
    return F.floor(length / 255) + 1


def frame_length_bytes(n: Column) -> Column:
    """Bytes of a coded frame length: one below 252, else two."""
    return F.when(n < 252, 1).otherwise(2)


def find_config(mode_: Column, bandwidth_: Column, samples: Column) -> Column:
    """The configuration (0 to 31) with this mode, bandwidth and frame of samples at 48 kHz; -1 if there is none."""
    all_ = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda c: F.struct(c.alias("c"), mode(c * 8).alias("m"), bandwidth(c * 8).alias("b"), frame_samples(c * 8).alias("s")))
    hit = F.filter(all_, lambda x: (x["m"] == mode_) & (x["b"] == bandwidth_) & (x["s"] == samples))
    return F.coalesce(F.get(hit, F.lit(0))["c"], F.lit(-1))


def lookahead(rate: Column, low_delay: Column) -> Column:
    """Samples by which an encoder lags behind its input."""
    return (F.floor(rate / 400) + F.when(low_delay, 0).otherwise(F.floor(rate / 250))).cast("long")


#: What the error codes 0, -1, -2, ... mean.
ERRORS = ["success", "invalid argument", "buffer too small", "internal error", "corrupted stream", "request not implemented", "invalid state", "memory allocation failed"]


def error_text(code: Column) -> Column:
    return F.coalesce(F.when(code <= 0, F.get(F.array(*map(F.lit, ERRORS)), -code)), F.lit("unknown error"))
