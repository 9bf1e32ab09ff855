"""Container files: written with a commit, read in any splits, with damage, foreign streams and packets over many pages."""

import os
import random

import pytest
from pyspark.sql import functions as F

from framelake.functions import container as C
from framelake.operators import pages
from framelake.sources.container_files import NAME, checksum, register


def page(serial, seq, segments, payload, flags=0, granule=0):
    whole = b"OggS" + bytes([0, flags]) + (granule % 2**64).to_bytes(8, "little") + serial.to_bytes(4, "little") + seq.to_bytes(4, "little") + bytes(4) + bytes([len(segments), *segments]) + payload
    return whole[:22] + checksum(whole).to_bytes(4, "little") + whole[26:]


def slow_checksum(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def laced(n):
    return [255] * (n // 255) + [n % 255]


def read(spark, path, split=1 << 26, **options):
    reader = spark.read.format(register(spark)).option("splitBytes", split)
    for k, v in options.items():
        reader = reader.option(k, v)
    rows = reader.load(str(path)).collect()
    return sorted((os.path.basename(r.path), r.at, -1 if r.place is None else r.place, r.serial, r.flags, r.granule and int(r.granule), None if r.payload is None else bytes(r.payload), r.error) for r in rows)


def test_checksums(spark):
    r = random.Random(1)
    data = [b"OggS" + r.randbytes(n) for n in (0, 1, 2, 23, 300)]
    rows = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary").select("i", C.crc(F.col("d")).alias("c"), C.crc(C.unsealed(F.col("d"))).alias("u")).collect()
    for x in rows:
        assert x.c == slow_checksum(data[x.i])
    whole = b"OggS" + r.randbytes(60)
    assert checksum(whole) == slow_checksum(whole[:22] + bytes(4) + whole[26:])


def streams(r):
    """A file of two interleaved streams, the second foreign; packets of 0 to 200,000 bytes, some over many pages, some pages with many packets."""
    out, packets, seq = [page(7, 0, laced(5), b"head!", C.FIRST), page(9, 0, laced(2), b"no", C.FIRST)], [(7, b"head!")], 1
    left: list = [r.randbytes(r.choice([0, 1, 100, 254, 255, 256, 510, 3000, 65_025, 200_000])) for _ in range(60)]
    stream = [(n, i == 0) for p in left for i, n in enumerate([p])]
    segments, body, begun = [], b"", False
    for p, _ in stream:
        packets.append((7, p))
        at = 0
        for n in laced(len(p)):
            segments.append(n)
            body += p[at : at + n]
            at += n
            if len(segments) == 255 or (n < 255 and r.random() < 0.2):
                out.append(page(7, seq, segments, body, C.CONTINUED if begun else 0, -1 if all(x == 255 for x in segments) else seq))
                seq, segments, body, begun = seq + 1, [], b"", n == 255
                if r.random() < 0.5:
                    out.append(page(9, seq, laced(9), b"different"))
    out.append(page(7, seq, segments, body, (C.CONTINUED if begun else 0) | C.LAST, seq))
    return b"".join(out), packets


def test_any_splits_give_the_same(spark, tmp_path):
    content, packets = streams(random.Random(4))
    os.mkdir(f"{tmp_path}/d")
    for name in ("a.ogg", "b.ogg"):
        with open(f"{tmp_path}/d/{name}", "wb") as f:
            f.write(content)
    open(f"{tmp_path}/d/_SUCCESS", "w").close()
    whole = read(spark, f"{tmp_path}/d")
    assert [x[6] for x in whole if x[0] == "a.ogg"] == [p for _, p in packets] and len({x[:3] for x in whole}) == len(whole) == 2 * len(packets)
    for split in (len(content) // 7 + 1, 70_001, 9_973):
        assert read(spark, f"{tmp_path}/d", split) == whole
    both = read(spark, f"{tmp_path}/d/a.ogg", 9_973, streams="all")
    assert [x for x in both if x[3] == 7] == [x for x in whole if x[0] == "a.ogg"] and {x[6] for x in both if x[3] == 9} == {b"no", b"different"}
    assert both == read(spark, f"{tmp_path}/d/a.ogg", streams="all")


def test_damage(spark, tmp_path):
    good = [page(1, 0, laced(4), b"head", C.FIRST), page(1, 1, laced(3), b"one"), page(1, 2, [255], b"x" * 255), page(1, 3, laced(3), b"two"), page(1, 4, [3], b"non", C.CONTINUED), page(1, 5, laced(5), b"three")]
    bad = bytearray(good[1])
    bad[-1] ^= 1
    cases = {
        "checksum": good[0] + bytes(bad) + b"".join(good[2:]), "junk": good[0] + b"junk!" + b"".join(good[1:]), "tail": b"".join(good)[:-2], "short": b"OggS", "none": b"", "not": b"RIFF" + b"".join(good), "flag": b"".join(good[1:]),
    }
    for name, content in cases.items():
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(content)
    for split in (1 << 20, 40):
        rows = read(spark, tmp_path, split)
        got = {n: [(x[6], x[7]) for x in rows if x[0] == n] for n in cases}
        ok = lambda *words: [(w, None) for w in words]
        assert got["checksum"] == ok(b"head") + [(None, "wrong checksum")] + ok(b"two", b"three")  # a packet that never goes on, and a page that continues nothing
        assert got["junk"] == ok(b"head") + [(None, "invalid page")] + ok(b"one", b"two", b"three")
        assert got["tail"] == ok(b"head", b"one", b"two") and got["short"] == [] and got["none"] == []
        assert got["not"] == [(None, "invalid page")] and got["flag"] == [(None, "invalid page")]


def test_granules_and_headers(spark, tmp_path):
    """Packets of one page end one after the other; what has no duration leaves the page's granule; none is below 0."""
    silk, celt = bytes([0x08]), bytes([0xE0])  # 20 ms and 2.5 ms, one frame
    head, tags = (bytes.fromhex(x) for x in ("4F707573486561640102380180BB0000000000", "4F707573546167730200000068690100000003000000613D62"))
    content = page(3, 0, laced(len(head)), head, C.FIRST) + page(3, 1, laced(len(tags)), tags) + page(3, 2, [1, 1, 0, 1], silk + celt + celt, 0, 5000) + page(3, 3, [1, 1, 1], celt + silk + celt, 0, 1000) + page(3, 4, [1, 2], silk + b"\x0b\x00", 0, 9000)
    with open(f"{tmp_path}/x.ogg", "wb") as f:
        f.write(content)
    found = spark.read.format(register(spark)).load(f"{tmp_path}")
    rows = pages.packet_granules(found).orderBy("at", "place").collect()
    assert [int(r.granule) for r in rows][2:] == [5000, 5000, 5000, 0, 880, 1000, 9000, 9000]
    (x,) = pages.open_streams(found).collect()
    assert x.error is None and x.head.channels == 2 and x.head.pre_skip == 312 and x.tags.vendor == "hi" and x.tags.comments == {"a": "b"}


def test_writing(spark, tmp_path):
    r = random.Random(6)
    sizes = {1: [10, 0, 70_000, 200_000, 65_025, 65_024, 5], 4_294_967_299: [3], 8: []}
    rows = [(s, i, 960, bytearray(r.randbytes(n))) for s, some in sizes.items() for i, n in enumerate(some)]
    packets = spark.createDataFrame(rows, "stream_id long, seq long, samples int, payload binary")
    long = lambda n: F.lit(n).cast("long")
    comments = F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: F.concat(F.lit("k"), i.cast("string"), F.lit("="), F.repeat(F.lit("v"), 300)))
    heads = spark.createDataFrame([(s,) for s in sizes], "stream_id long").select("stream_id", C.head(long(1), long(0), long(48_000), long(0), long(0)).alias("head"), C.tags(F.lit("f"), comments).alias("tags"))
    written = pages.write_pages(packets, heads)
    assert written.filter("page is null").count() == 0 and pages.read_pages(written.select("page")).filter("error is not null").count() == 0
    name = register(spark)
    written.repartition("stream_id").sortWithinPartitions("stream_id", "page_seq").write.format(name).mode("append").save(f"{tmp_path}/out")
    assert sorted(os.listdir(f"{tmp_path}/out")) == sorted(f"{s}.ogg" for s in sizes)
    found = spark.read.format(name).option("splitBytes", 30_000).load(f"{tmp_path}/out")
    opened = {x.serial: x for x in pages.open_streams(found).collect()}
    assert len(opened) == 3 and all(x.error is None and len(x.tags.comments) == 401 for x in opened.values())
    back = sorted((x.serial, x.at, bytes(x.payload), int(x.granule)) for x in pages.packet_granules(found).collect())
    for s, some in sizes.items():
        mine = [(p, g) for serial, _, p, g in back if serial == s % 2**32][2:]
        assert mine == [(bytes(x[3]), 960 * (x[1] + 1)) for x in rows if x[0] == s and x[3]]
    # the same pages by way of rows
    again = pages.packets_of_pages(pages.read_pages(written.select("page"))).filter("serial = 1").collect()
    assert {bytes(x.payload) for x in again} >= {bytes(x[3]) for x in rows if x[0] == 1 and x[3]}


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows = [(1, 0, bytearray(b"a")), (1, 1, bytearray(b"b")), (2, 0, None)]
    df = spark.createDataFrame(rows, "stream_id long, page_seq long, page binary").coalesce(1)
    spread = spark.createDataFrame([(1, i, bytearray(b"a")) for i in range(8)], "stream_id long, page_seq long, page binary").repartitionByRange(4, "page_seq")
    for bad in (df, spread, df.filter("stream_id = 1").orderBy(F.desc("page_seq"))):
        with pytest.raises(Exception, match="null|several tasks|ascend"):
            bad.write.format(register(spark)).mode("append").save(f"{tmp_path}/out")
        assert not os.path.exists(f"{tmp_path}/out") or os.listdir(f"{tmp_path}/out") == []
    df.filter("stream_id = 1").write.format(NAME).mode("append").save(f"{tmp_path}/out")
    assert os.listdir(f"{tmp_path}/out") == ["1.ogg"]
    df.filter("stream_id = 1").withColumn("stream_id", F.lit(5).cast("long")).write.format(NAME).mode("overwrite").save(f"{tmp_path}/out")
    assert os.listdir(f"{tmp_path}/out") == ["5.ogg"]
