"""Container pages and stream headers (RFC 3533, RFC 7845) as columns over bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.layouts import SILENT, lacing, layout
from framelake.functions.wire import digits, let, number, part

PAGE, HEAD, TAGS = "OggS", "OpusHead", "OpusTags"
HEADER_BYTES = 27
CONTINUED, FIRST, LAST = 1, 2, 4
#: Every byte with its bits in reverse; 0 stands for itself.
_BYTES = "".join(map(chr, range(1, 256)))
_MIRRORED = "".join(chr(int(f"{b:08b}"[::-1], 2)) for b in range(1, 256))


def _hex(text: str) -> Column:
    return F.lit(text.encode().hex().upper())


def crc(data: Column) -> Column:
    """Checksum of a page whose checksum bytes are zero: a cyclic remainder from 0, bytes from their high bit on.

    crc32() takes bytes from their low bit on, starts from ones and ends with a complement. So all bits are mirrored before and after; and a start from
    ones over four inverted bytes is one from zeros. Data has four bytes at least, as every page has."""
    def turned(mirrored: Column) -> Column:
        head = F.conv(F.hex(F.substring(mirrored, F.lit(1), F.lit(4))), 16, 10).cast("long")
        return F.concat(F.unhex(digits(F.lit(0xFFFFFFFF).bitwiseXOR(head), 4)), F.substring(mirrored, F.lit(5), F.octet_length(mirrored)))

    mirrored = F.encode(F.translate(F.decode(data, "ISO-8859-1"), _BYTES, _MIRRORED), "ISO-8859-1")
    low_first = F.crc32(let(mirrored, turned)).bitwiseXOR(F.lit(0xFFFFFFFF))
    return F.conv(F.reverse(F.lpad(F.bin(low_first), 32, "0")), 2, 10).cast("long")


PAGE_SEGMENTS = 255
PAGE_BYTES = 255 * PAGE_SEGMENTS


def page_parts(payload: Column, last: Column) -> Column:
    """How a packet is laid on pages: for each page its segments, its bytes, and whether it goes on from one before and to one behind. A page takes
    255 segments. The empty packet of a last page has no segment."""
    n = F.octet_length(payload)
    pages = F.floor(F.floor(n / 255) / PAGE_SEGMENTS).cast("int")

    def on(k: Column) -> Column:
        rest = (n - k * PAGE_BYTES).cast("int")
        goes_on = k < pages
        segments = F.when(goes_on, F.array_repeat(F.lit(255), PAGE_SEGMENTS)).when((n == 0) & last, F.array().cast("array<int>")).otherwise(lacing(rest))
        return F.struct(k.alias("k"), segments.alias("segments"), part(payload, k * PAGE_BYTES, F.least(rest, F.lit(PAGE_BYTES))).alias("bytes"), goes_on.alias("goes_on"))

    return F.transform(F.sequence(F.lit(0), pages), on)


def bare_page(segments: Column, payload: Column, flags: Column, granule: Column, serial: Column, sequence: Column) -> Column:
    """A page with a checksum of zero."""
    table = F.array_join(F.transform(segments, lambda n: digits(n)), "")
    head = F.unhex(F.concat(_hex(PAGE), F.lit("00"), digits(flags), digits(granule, 8, True), digits(serial, 4, True), digits(sequence, 4, True), F.lit("00000000"), digits(F.size(segments)), table))
    return F.concat(head, payload)


def sealed(page: Column) -> Column:
    """The page with its checksum."""
    return F.concat(part(page, F.lit(0), F.lit(22)), F.unhex(digits(crc(page), 4, True)), part(page, F.lit(26), F.octet_length(page)))


def unsealed(page: Column) -> Column:
    """The page with a checksum of zero."""
    return F.concat(part(page, F.lit(0), F.lit(22)), F.lit(bytes(4)), part(page, F.lit(26), F.octet_length(page)))


def head(channels: Column, pre_skip: Column, rate: Column, gain: Column, family: Column) -> Column:
    """The first packet of a stream; families other than 0 take the standard layout of the channels."""
    start = F.concat(_hex(HEAD), F.lit("01"), digits(channels), digits(pre_skip, 2, True), digits(rate, 4, True), digits(F.pmod(gain, F.lit(65536)), 2, True), digits(family))
    x = layout(channels)
    return F.unhex(F.when(family == 0, start).otherwise(F.concat(start, digits(x["streams"]), digits(x["coupled"]), F.array_join(F.transform(x["mapping"], lambda n: digits(n)), ""))))


def read_head(data: Column) -> Column:
    """Struct of channels, pre_skip, rate, gain (signed, 1/256 dB), family, streams, coupled and mapping; null for an invalid header. Family 3
    has its matrix in place of the mapping, which is null then."""
    at = lambda i, n=1: number(data, F.lit(i), n, little=True)
    channels, family, size = at(9), at(18), F.octet_length(data)
    gain = F.when(at(16, 2) < 32768, at(16, 2)).otherwise(at(16, 2) - 65536)
    streams = F.when(family == 0, 1).otherwise(at(19))
    coupled = F.when(family == 0, (channels == 2).cast("long")).otherwise(at(20))
    mapping = F.when((family != 0) & (family != 3), F.transform(F.sequence(F.lit(0), channels.cast("int") - 1), lambda i: number(data, i + 21).cast("int")))
    good = (size >= 19) & (part(data, F.lit(0), F.lit(8)) == F.lit(HEAD.encode())) & (at(8) == 1) & (channels > 0)
    single = (family == 0) & (channels <= 2)
    several = (family != 0) & (size >= 21) & (at(19) > 0) & (at(20) <= at(19))
    placed = (family == 3) & (size >= 21 + 2 * channels * (at(19) + at(20))) | (family != 3) & (size >= 21 + channels) & F.forall(mapping, lambda c: (c < at(19) + at(20)) | (c == SILENT))
    made = F.struct(channels.alias("channels"), at(10, 2).alias("pre_skip"), at(12, 4).alias("rate"), gain.alias("gain"), family.alias("family"), streams.alias("streams"), coupled.alias("coupled"), mapping.alias("mapping"))
    return F.when(good & (single | (several & placed)), made)


def tags(vendor: Column, comments: Column) -> Column:
    """The second packet of a stream, of a vendor and an array of comments `KEY=value`."""
    text = lambda c: F.concat(digits(F.octet_length(c), 4, True), F.hex(c))
    return F.unhex(F.concat(_hex(TAGS), text(vendor), digits(F.size(comments), 4, True), F.array_join(F.transform(comments, text), "")))


def read_tags(data: Column) -> Column:
    """Struct of vendor and comments (a map; comments without `=` are passed over, the last of a key counts); null for an invalid header."""
    size = F.octet_length(data)
    vendor = number(data, F.lit(8), 4, little=True)
    count = number(data, vendor + 12, 4, little=True)
    start = F.struct((vendor + 16).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        n = number(data, s["at"], 4, little=True)
        ends = s["at"] + 4 + n
        return F.struct(F.when(ends <= size, ends).alias("at"), F.concat(s["out"], F.array(part(data, s["at"] + 4, n).cast("string"))).alias("out"))

    # each comment has four bytes at least, so a count that the data can't hold ends the walk at once
    walk = F.aggregate(F.when((count > 0) & (count <= size), F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<long>")), start, step)
    pairs = F.filter(walk["out"], lambda c: F.instr(c, "=") > 0)
    key = lambda c: F.substring_index(c, "=", 1)
    # by key, and of a key by place: the last of each is kept
    placed = F.array_sort(F.transform(pairs, lambda c, i: F.struct(key(c).alias("k"), i.alias("i"), F.substr(c, F.instr(c, "=") + 1).alias("v"))))
    beside = F.arrays_zip(placed.alias("a"), F.slice(placed, F.lit(2), F.greatest(F.size(placed), F.lit(1))).alias("b"))
    kept = F.filter(beside, lambda x: F.coalesce(x["a"]["k"] != x["b"]["k"], F.lit(True)))
    last = F.map_from_entries(F.transform(kept, lambda x: F.struct(x["a"]["k"], x["a"]["v"])))
    good = (size >= 16) & (part(data, F.lit(0), F.lit(8)) == F.lit(TAGS.encode())) & (vendor + 16 <= size) & (count <= size) & walk["at"].isNotNull()
    return F.when(good, F.struct(part(data, F.lit(12), vendor).cast("string").alias("vendor"), last.alias("comments")))
