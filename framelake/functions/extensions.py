"""Extensions in the padding of packets: rows or a table function that list them, and the bytes of a list.

An extension has an id of 3 to 127, a frame and data. Ids below 32 have at most one byte of data, the others any number, whose length is written
unless theirs is the last. A 1 goes on to the next frame or some frames ahead; a 2 repeats the extensions since then, with other data, in every
later frame; a zero byte ends all, and a byte of value 1 is padding."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import BinaryType

MOST_FRAMES = 48
FIRST_ID, FIRST_LONG, LAST_ID = 3, 32, 127
NEXT, AHEAD, REPEAT_AND_LEAVE, REPEAT_AND_STAY, FILLER = 2, 3, 4, 5, 1
LISTED = "place int, id int, frame int, data binary, error string"


class Malformed(ValueError):
    """Bytes that aren't a list of extensions, or a list that has no bytes."""


class Cursor:
    """A place in the bytes of a list."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n > self.left():
            raise Malformed("invalid packet")
        self.at += n
        return self.data[self.at - n : self.at]

    def body(self, id_: int, sized: bool, spare: int = 0) -> bytes:
        """The data of an extension: `sized` is whether it has its one byte, or its length ahead; else a long one takes all but `spare` bytes."""
        if 0 < id_ < FIRST_LONG:
            return self.take(int(sized))
        if not sized:
            if self.left() < spare:
                raise Malformed("invalid packet")
            return self.take(self.left() - spare)
        n = 0
        while True:
            (more,) = self.take(1)
            n += more
            if more < 255:
                return self.take(n)


def listed(data: bytes, frames: int) -> list[tuple[int, int, bytes]]:
    """Id, frame and data of all extensions as they stand in a packet of so many frames; Malformed for what can't be."""
    frames = max(0, min(frames, MOST_FRAMES))
    c, frame, out = Cursor(data), 0, []
    model: list[tuple[int, bool]] = []  # what a repeat would repeat: id, and whether sized
    while c.left() and frame < frames:
        (head,) = c.take(1)
        id_, flag = head >> 1, bool(head & 1)
        if id_ == 0:
            if not flag:
                break
        elif id_ == 1:
            step = c.take(1)[0] if flag else 1
            frame += step
            if step and frame >= frames:
                raise Malformed("invalid packet")
            model = model if not step else []
        elif id_ == 2:
            long = max((i for i, (x, _) in enumerate(model) if x >= FIRST_LONG), default=None)
            spare = sum(sized for x, sized in model[long + 1 :]) if long is not None else 0
            for later in range(frame + 1, frames):
                for i, (x, sized) in enumerate(model):
                    open_end = not flag and later == frames - 1 and i == long
                    out.append((x, later, c.body(x, sized and not open_end, spare)))
            model = []
            if not flag:
                frame += 1
        else:
            out.append((id_, frame, c.body(id_, flag)))
            model.append((id_, flag))
    return out


def written(extensions: list[tuple[int, int, bytes]], frames: int) -> bytes:
    """The bytes of extensions (id, frame, data), those of a frame in their order; what all later frames have alike is repeated."""
    if not 0 <= frames <= MOST_FRAMES or any(not FIRST_ID <= i <= LAST_ID or not 0 <= f < frames or (i < FIRST_LONG and len(d) > 1) for i, f, d in extensions):
        raise Malformed("invalid argument")
    waiting: list[list[tuple[int, bytes]]] = [[(i, d) for i, f, d in extensions if f == g] for g in range(frames)]
    out, at, left = bytearray(), 0, len(extensions)

    def body(id_: int, data: bytes, open_end: bool) -> bytes:
        return data if id_ < FIRST_LONG or open_end else bytes([255] * (len(data) // 255) + [len(data) % 255]) + data

    alike = lambda a, b: a[0] == b[0] and (a[0] >= FIRST_LONG or len(a[1]) == len(b[1]))
    for frame in range(frames):
        own, later = waiting[frame], waiting[frame + 1 :]
        common = 0
        while later and common < len(own) and all(common < len(w) and alike(own[common], w[common]) for w in later):
            common += 1
        if own and frame > at:
            out += bytes([NEXT]) if frame == at + 1 else bytes([AHEAD, frame - at])
            at = frame
        for place, (id_, data) in enumerate(own):
            left -= 1
            out.append(id_ << 1 | (len(data) if id_ < FIRST_LONG else int(left > 0)))
            out += body(id_, data, left == 0)
            if place + 1 == common:
                left -= common * len(later)
                longs = [i for i in range(common) if own[i][0] >= FIRST_LONG]
                leave = left == 0 or (not longs and common == len(own))
                out.append(REPEAT_AND_LEAVE if leave else REPEAT_AND_STAY)
                for n, w in enumerate(later):
                    for i in range(common):
                        out += body(*w[i], leave and n == len(later) - 1 and longs[-1:] == [i])
                    del w[:common]
                at += int(leave)
    return bytes(out)


@udtf(returnType=LISTED, useArrow=True)
class PacketExtensions:
    """A row for each extension of (padding, frames), in their order; for a malformed list one row with its error; none for a null."""

    def eval(self, padding: bytes, frames: int) -> Iterator[tuple]:
        yield from _rows(padding, frames)


def _rows(padding: bytes | None, frames: int | None) -> list[tuple]:
    if padding is None or frames is None:
        return []
    try:
        return [(place, id_, frame, data, None) for place, (id_, frame, data) in enumerate(listed(bytes(padding), frames))]
    except Malformed as e:
        return [(None, None, None, None, str(e))]


_LISTS = pa.list_(pa.struct([("place", pa.int32()), ("id", pa.int32()), ("frame", pa.int32()), ("data", pa.binary()), ("error", pa.string())]))


@F.arrow_udf(from_arrow_type(_LISTS))
def _listed(padding: pa.Array, frames: pa.Array) -> pa.Array:
    names = [f.name for f in _LISTS.value_type]
    return pa.array([[dict(zip(names, x)) for x in _rows(p, n)] for p, n in zip(padding.to_pylist(), frames.to_pylist())], _LISTS)


def extensions_of(rows: DataFrame, padding: Column, frames: Column) -> DataFrame:
    """Each row of a table beside each of its extensions: place, id, frame, data and error; rows without any are left out."""
    return rows.select(*rows.columns, F.inline(_listed(padding, frames.cast("int"))))


def found(extensions: DataFrame, keys: list[str], id_: int) -> DataFrame:
    """The first extension with this id of each packet: keys, frame and data."""
    first = extensions.filter(F.col("id") == id_).groupBy(*keys).agg(F.min_by(F.struct("frame", "data"), "place").alias("x"))
    return first.select(*keys, "x.frame", "x.data")


def by_frame(extensions: DataFrame, keys: list[str]) -> DataFrame:
    """How many extensions each frame of a packet has: keys, frame and n."""
    return extensions.filter("id is not null").groupBy(*keys, "frame").agg(F.count("*").alias("n"))


def in_frame_order(extensions: DataFrame, keys: list[str]) -> DataFrame:
    """The extensions of each packet by frame, and of a frame as they stand: keys and extensions, an array of struct(frame, place, id, data)."""
    return extensions.filter("id is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", "place", "id", "data"))).alias("extensions"))


@F.arrow_udf(BinaryType())
def extension_bytes(extensions: pa.Array, frames: pa.Array) -> pa.Array:
    """The bytes of an array of struct(id, frame, data) in packets of so many frames; null for a list that has none."""

    def one(some, n):
        try:
            return written([(x["id"], x["frame"], bytes(x["data"])) for x in some], int(n))
        except (Malformed, TypeError):
            return None

    return pa.array([one(some, n) for some, n in zip(extensions.to_pylist(), frames.to_pylist())], pa.binary())
