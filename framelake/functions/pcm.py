"""Columns over arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.wire import digits, number


def to_int16(pcm: Column) -> Column:
    """Scale by 32768, round half to even, clamp."""
    return F.transform(pcm, lambda x: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(x.cast("double") * 32768))).cast("int"))


def to_int24(pcm: Column) -> Column:
    """Scale by 2^23, round half to even."""
    return F.transform(pcm, lambda x: F.rint(x.cast("double") * 8388608).cast("int"))


def from_int16(pcm: Column) -> Column:
    return F.transform(pcm, lambda x: (x / 32768).cast("float"))


def gain(pcm: Column, q8: Column) -> Column:
    """Louder by a header's gain, a 256th of a decibel each, as a power of two in single precision; a gain of 0 or null changes nothing."""
    factor = F.pow(F.lit(2.0), F.lit(6.48814081e-4) * q8).cast("float")
    return F.when(F.coalesce(q8, F.lit(0)) == 0, pcm).otherwise(F.transform(pcm, lambda x: (x * factor).cast("float")))


def float_bits(x: Column) -> Column:
    """The 32 bits of a single-precision number as a whole number: sign, exponent and fraction, worked out, as no function gives them."""
    a = F.abs(x.cast("double"))
    guess = F.floor(F.log2(a))
    exponent = F.greatest(F.lit(-126), F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess))
    fraction = (a / F.pow(F.lit(2.0), exponent - 23)).cast("long")
    # the leading one of a normal number adds one to the exponent's field
    size = F.when(a == 0, 0).when(F.isnan(a), 0x7FC00000).when(a == float("inf"), 0x7F800000).otherwise((exponent + 126) * (1 << 23) + fraction)
    negative = (x < 0) | ((x == 0) & (F.concat(x.cast("string")).startswith("-")))
    return (size + F.when(negative, F.lit(1 << 31)).otherwise(F.lit(0))).cast("long")


def float_bytes(pcm: Column) -> Column:
    """Single-precision samples as little-endian bytes."""
    return F.unhex(F.array_join(F.transform(pcm, lambda x: digits(float_bits(x), 4, little=True)), ""))


def from_float_bytes(data: Column) -> Column:
    """Single-precision samples from little-endian bytes; what is left at the end is left out."""
    n = F.floor(F.octet_length(data) / 4).cast("int")

    def at(i: Column) -> Column:
        bits = number(data, 4 * i, 4, little=True)
        exponent, fraction = F.floor(bits / (1 << 23)) % 256, bits % (1 << 23)
        a = F.when(exponent == 0, fraction * 2.0**-149).otherwise((fraction + (1 << 23)) * F.pow(F.lit(2.0), exponent - 150))
        a = F.when(exponent < 255, a).when(fraction == 0, float("inf")).otherwise(float("nan"))
        return F.when(bits >= 1 << 31, -a).otherwise(a).cast("float")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<float>"))


def interleave(channels: list[Column]) -> Column:
    """Interleaved samples of channels of equal length."""
    return F.flatten(F.transform(F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(channels)]), lambda x: F.array(*[x[f"c{i}"] for i in range(len(channels))])))


def energy(pcm: Column) -> Column:
    """Mean of squares, 0 for no sample."""
    total = F.aggregate(pcm, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(pcm) > 0, total / F.size(pcm)).otherwise(F.lit(0.0))


def peak(pcm: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(pcm, lambda x: F.abs(x).cast("double"))), F.lit(0.0))


def is_silent(pcm: Column, depth: int = 24) -> Column:
    """Every sample at most one step of the depth (8 to 24 bits)."""
    step = 1.0 / (1 << max(8, min(24, depth)))
    return F.forall(pcm, lambda x: F.abs(x) <= step)


def channel(pcm: Column, of: int, index: int) -> Column:
    """One channel of interleaved samples."""
    return F.filter(pcm, lambda x, i: i % of == index)


def trim_silence(pcm: Column, threshold: float, keep: int) -> Column:
    """Without head and tail at or under the threshold, but for `keep` samples on each side; quiet input stays as it is."""
    loud = F.filter(F.transform(pcm, lambda x, i: F.when(F.abs(x) > threshold, i)), lambda i: i.isNotNull())
    first = F.greatest(F.lit(0), F.array_min(loud) - keep)
    last = F.least(F.size(pcm) - 1, F.array_max(loud) + keep)
    return F.when(F.size(loud) > 0, F.slice(pcm, first + 1, last - first + 1)).otherwise(pcm)


def cross_fade(out: Column, into: Column) -> Column:
    """Blend of two blocks of equal length under a squared sine window."""
    pairs = F.arrays_zip(out.alias("a"), into.alias("b"))
    w = lambda i: F.pow(F.sin((i + 0.5) / F.size(out) * 3.141592653589793 / 2), 2)
    return F.transform(pairs, lambda p, i: (1 - w(i)) * p["a"] + w(i) * p["b"])


def to_symmetric_int16(pcm: Column) -> Column:
    """to_int16() with the same limit on both sides."""
    return F.transform(pcm, lambda x: F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), F.rint(x.cast("double") * 32768))).cast("int"))


def from_int24(pcm: Column) -> Column:
    return F.transform(pcm, lambda x: (x / 8388608).cast("float"))


def to_bytes(pcm: Column) -> Column:
    """16-bit integers as little-endian bytes."""
    return F.unhex(F.array_join(F.transform(pcm, lambda x: digits(F.pmod(x, F.lit(65536)), 2, little=True)), ""))


def from_bytes(data: Column) -> Column:
    """16-bit integers from little-endian bytes; an odd byte at the end is left out."""
    n = F.floor(F.octet_length(data) / 2).cast("int")
    value = lambda i: number(data, 2 * i, 2, little=True)
    signed = lambda i: F.when(value(i) < 32768, value(i)).otherwise(value(i) - 65536).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), signed)).otherwise(F.array().cast("array<int>"))


def downmix(pcm: Column, channels: int) -> Column:
    """The mean of all channels of interleaved samples."""
    n = F.floor(F.size(pcm) / channels).cast("int")
    frame = lambda i: sum((F.get(pcm, i * channels + k).cast("double") for k in range(1, channels)), F.get(pcm, i * channels).cast("double")) / channels
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), frame)).otherwise(F.array().cast("array<double>"))


def pan(pcm: Column, place: Column) -> Column:
    """Interleaved stereo from mono, of equal power at every place from -1 (left) to 1 (right)."""
    angle = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), place)) + 1) * 3.141592653589793 / 4
    return F.flatten(F.transform(pcm, lambda x: F.array(x * F.cos(angle), x * F.sin(angle))))


def normalize_peak(pcm: Column, target: float) -> Column:
    """Scaled down to the target where a sample is above it."""
    return F.when(peak(pcm) > target, F.transform(pcm, lambda x: x * (target / peak(pcm)))).otherwise(F.transform(pcm, lambda x: x.cast("double")))


def resample(pcm: Column, source: int, target: int) -> Column:
    """Linear interpolation from one rate to another; the last sample is held."""
    n = F.greatest(F.lit(1), F.round(F.size(pcm) * target / source)).cast("int")
    last = F.size(pcm) - 1

    def at(i: Column) -> Column:
        place = i * (source / target)
        k = F.floor(place).cast("int")
        a, b = F.get(pcm, k).cast("double"), F.get(pcm, k + 1).cast("double")
        return F.when(k >= last, F.get(pcm, last).cast("double")).otherwise(a + (b - a) * (place - k))

    return F.when(F.size(pcm) > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def concealed_chunks(remaining: Column, silk: Column, rate: int = 48_000) -> Column:
    """Samples of the steps in which a loss is concealed: 20 ms while there are so many, then 10, then 5 (but for silk), then the rest."""
    f20, f10, f5 = rate // 50, rate // 100, rate // 200
    r1 = remaining % f20
    r2 = F.when(r1 > f10, r1 - f10).otherwise(r1)
    splits = ~silk & (r2 > f5) & (r2 < f10)
    parts = F.concat(F.array_repeat(F.lit(f20), F.floor(remaining / f20).cast("int")), F.array(F.when(r1 > f10, f10), F.when(splits, f5), F.when(splits, r2 - f5).when(r2 > 0, r2).cast("int")))
    return F.array_compact(parts)
