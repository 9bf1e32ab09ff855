"""Columns over bytes on the wire. Places count from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(data: Column, at: Column, n: int = 1, little: bool = False) -> Column:
    """n bytes (7 at most) as a number, big-endian or little; null past the end."""
    if little and n > 1:
        return sum((number(data, at + i) * (1 << 8 * i) for i in range(1, n)), number(data, at))
    raw = F.substring(data, (at + 1).cast("int"), F.lit(n))
    return F.when(F.octet_length(raw) == n, F.conv(F.hex(raw), 16, 10).cast("long"))


def digits(value: Column, n: int = 1, little: bool = False) -> Column:
    """The n bytes of a number as hexadecimal digits; null where it needs more (a negative number needs eight)."""
    def laid(whole: Column) -> Column:
        big = F.when(F.length(whole) <= 2 * n, F.lpad(whole, 2 * n, "0"))
        return let(big, lambda b: F.concat(*[F.substring(b, 2 * i - 1, 2) for i in range(n, 0, -1)])) if little else big

    return let(F.hex(value.cast("long")), laid)


def part(data: Column, at: Column, length: Column) -> Column:
    return F.substring(data, (at + 1).cast("int"), length.cast("int"))


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), made), F.lit(0))
