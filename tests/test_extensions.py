"""Extensions of packets: bytes made by hand, lists that come back, malformed bytes, and padding that keeps them."""

import random

import pytest
from pyspark.sql import functions as F

from framelake.functions.extensions import Malformed, by_frame, extension_bytes, extensions_of, found, in_frame_order, listed, written
from framelake.operators import framing

#: Frames, bytes, and what they hold: id, frame and data.
CASES = [
    (1, "", []),
    (1, "06", [(3, 0, "")]),
    (1, "0741", [(3, 0, "41")]),
    (2, "0741 02 0742 ", [(3, 0, "41"), (3, 1, "42")]),
    (4, "0741 0302 0742", [(3, 0, "41"), (3, 2, "42")]),
    (1, "40414243", [(32, 0, "414243")]),
    (1, "4101410741", [(32, 0, "41"), (3, 0, "41")]),
    (1, "01010741 00ffff", [(3, 0, "41")]),
    (1, "41" + "ff01" + "78" * 256, [(32, 0, "78" * 256)]),
    (3, "0741 04 4243", [(3, 0, "41"), (3, 1, "42"), (3, 2, "43")]),
    (3, "410141 0742 04 0143 44 4546 47", [(32, 0, "41"), (3, 0, "42"), (32, 1, "43"), (3, 1, "44"), (32, 2, "4546"), (3, 2, "47")]),
    (2, "0741 05 42 0943", [(3, 0, "41"), (3, 1, "42"), (4, 0, "43")]),
    (2, "0741 0300 0942", [(3, 0, "41"), (4, 0, "42")]),
    (0, "0741", []),
]
MALFORMED = [(1, "07"), (1, "02"), (2, "0303"), (1, "03"), (1, "4105"), (1, "41ff"), (2, "0741 04"), (2, "410141 0742 04")]


@pytest.mark.parametrize("frames, data, expected", CASES)
def test_lists(frames, data, expected):
    assert [(i, f, d.hex()) for i, f, d in listed(bytes.fromhex(data), frames)] == expected


@pytest.mark.parametrize("frames, data", MALFORMED)
def test_malformed(frames, data):
    with pytest.raises(Malformed):
        listed(bytes.fromhex(data), frames)


def test_shortest_bytes():
    x = lambda *some: [(i, f, bytes.fromhex(d)) for i, f, d in some]
    assert written(x((3, 0, "41"), (3, 1, "42"), (3, 2, "43")), 3).hex() == "0741044243"
    assert written(x((3, 0, "41"), (3, 1, "42"), (4, 0, "43")), 2).hex() == "0741" + "05" + "42" + "0943"
    assert written(x((32, 0, "4142")), 1).hex() == "404142" and written(x((32, 0, "41"), (3, 2, "")), 3).hex() == "410141" + "0302" + "06"
    assert written(x((32, 0, "41"), (3, 0, "42"), (32, 1, "43"), (3, 1, "44"), (32, 2, "4546"), (3, 2, "47")), 3).hex() == "410141074204" + "014344" + "454647"
    for bad in ((2, 0, ""), (128, 0, ""), (3, 1, ""), (3, 0, "4142")):
        with pytest.raises(Malformed):
            written(x(bad), 1)


def test_any_list_comes_back():
    r = random.Random(1)
    for _ in range(2000):
        frames = r.randint(1, 6)
        ids = [r.choice([3, 5, 31, 32, 40, 127]) for _ in range(r.randint(0, 3))]
        some = [(i, f, r.randbytes(r.randint(0, 1) if i < 32 else r.choice([0, 1, 254, 255, 600]))) for f in range(frames) for i in (ids if r.random() < 0.9 else ids[:1] + [33])]
        data = written(some, frames)
        got = listed(data, frames)
        order = lambda rows: [[x for x in rows if x[1] == f] for f in range(frames)]
        assert order(got) == order(some) and listed(b"\x01" * 9 + data, frames) == got


def test_beside_rows(spark):
    rows = [(i, f, bytearray.fromhex(d)) for i, (f, d, _) in enumerate(CASES)] + [(50, 1, None), (51, None, bytearray(b"\x06")), (52, *((f, bytearray.fromhex(d)) for f, d in MALFORMED[:1]).__next__())]
    df = spark.createDataFrame(rows, "n int, m int, p binary")
    all_ = extensions_of(df, F.col("p"), F.col("m")).select("n", "place", "id", "frame", "data", "error")
    got = [tuple(x) for x in all_.collect()]
    assert [x for x in got if x[0] >= 50] == [(52, None, None, None, None, "invalid packet")]
    for i, (_, _, expected) in enumerate(CASES):
        assert [(x[2], x[3], bytes(x[4]).hex()) for x in sorted((x for x in got if x[0] == i), key=lambda x: x[1])] == expected
    assert {x.n: (x.frame, bytes(x.data).hex()) for x in found(all_, ["n"], 4).collect()} == {11: (0, "43"), 12: (0, "42")}
    assert [(y.frame, y.id) for x in in_frame_order(all_, ["n"]).filter("n = 11").collect() for y in x.extensions] == [(0, 3), (0, 4), (1, 3)]
    back = all_.filter("id is not null").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("place", "id", "frame", "data"))).alias("x")).join(df.select("n", "m"), "n")
    made = {x.n: bytes(x.b) for x in back.select("n", extension_bytes("x", "m").alias("b")).collect()}
    assert made[10] == bytes.fromhex(CASES[10][1].replace(" ", "")) and made[9].hex() == "0741044243"


def test_padding_keeps_extensions(spark):
    df = spark.createDataFrame([(bytearray.fromhex("4b410421ff" + "0741" + "0000"),), (bytearray.fromhex("48112233"),)], "payload binary")
    got = [(x.padded and bytes(x.padded).hex(), x.error) for x in framing.pad(df, F.lit(12)).collect()]
    assert got == [("4b410721ff" + "010101" + "07410000", None), ("4b4106112233000000000000", None)] or got[0][0].endswith("07410000") and got[1] == ("4b4106112233000000000000", None)
    again = framing.pad(framing.pad(df.limit(1), F.lit(300)).select(F.col("padded").alias("payload")), F.lit(700)).select(F.col("padded").alias("payload"))
    parsed = framing.parse(again)
    (x,) = extensions_of(parsed.select(framing.padding_of(parsed).alias("p")), F.col("p"), F.lit(1)).collect()
    assert (x.id, bytes(x.data)) == (3, b"A") and parsed.first().padding > 0


def test_streams_padded_and_bare(spark):
    """Only the last stream grows; all lose their padding; what can't be split or is too long has an error."""
    toc, one = F.lit(0x48), lambda *x: F.array(*[F.lit(bytes(y, "ascii")) for y in x])
    whole = framing.join_streams([toc] * 3, [one("ab", "c"), one("def", "g"), one("hi", "jk")])
    df = spark.range(1).select(whole.alias("payload"))
    n = len(df.first().payload)
    padded = framing.pad_streams(df, 3, F.lit(n + 30)).select(F.col("padded").alias("payload"), "error")
    x = padded.first()
    assert x.error is None and len(x.payload) == n + 30 and bytes(x.payload)[:8] == bytes(df.first().payload)[:8]
    assert bytes(framing.unpad_streams(padded.select("payload"), 3).first().bare) == bytes(df.first().payload)
    assert framing.pad_streams(df, 3, F.lit(n - 1)).first().error == "too long" and framing.pad_streams(df, 3, F.lit(n)).first().padded == df.first().payload
    assert framing.unpad_streams(df.select(F.lit(b"\x4b").alias("payload")), 2).first().error is not None
