"""Whole files, as the binaryFile source reads them (path, content), taken apart into rows. A file is read by one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import packets as P
from framelake.functions.pcm import from_bytes
from framelake.functions.wire import number, part

VECTORS = "path string, seq long, final_range long, payload binary"


def vectors(files: DataFrame) -> DataFrame:
    """Records of a length, a final range (both of 32 bits, big-endian) and that many bytes: path, seq, final_range and payload, up to the
    first that isn't whole. A length of 0 is a lost packet, whose payload is null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, at, content = [], 0, content or b""
                while at + 8 <= len(content):
                    size, last = (int.from_bytes(content[i : i + 4], "big") for i in (at, at + 4))
                    if at + 8 + size > len(content):
                        break
                    rows.append((path, len(rows), last, content[at + 8 : at + 8 + size] or None))
                    at += 8 + size
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["path", "seq", "final_range", "payload"])

    return files.select("path", "content").mapInArrow(cut, VECTORS)


def vector_summary(records: DataFrame) -> DataFrame:
    """Of vectors() by path: packets, bytes, first_toc, and duration, as if every packet were one frame of the first one's size. Where the first is lost or empty, the last two are null."""
    first = number(F.min_by(F.coalesce("payload", F.lit(b"")), "seq"), F.lit(0))
    rows = records.groupBy("path").agg(F.count("*").alias("packets"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes"), first.alias("first_toc"))
    return rows.withColumn("duration", F.col("packets") * P.frame_samples(F.col("first_toc")))


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Cases of JSON files {version, cases: [...]}: a row for each, with the file's version and the case's fields. Fields whose names end in _b64 are decoded; packets, where there are
    any, are an array of struct(data, final_range)."""
    rows = spark.read.option("multiLine", True).json(path).select("version", F.inline("cases"))
    coded = {f.name: F.unbase64(f.name) for f in rows.schema if f.name.endswith("_b64")}
    if "packets" in rows.columns:
        rows = rows.withColumn("packets", F.transform("packets", lambda p: F.struct(F.unbase64(p["data_b64"]).alias("data"), p["final_range"].alias("final_range"))))
    return rows.withColumns(coded).withColumnsRenamed({name: name.removesuffix("_b64") for name in coded})


def wav(files: DataFrame) -> DataFrame:
    """16-bit PCM in RIFF files to path, channels, rate and pcm (interleaved integers); error where a file isn't such a one.

    Chunks before the samples are passed over: sixteen at first, and where that isn't enough, as many as the file can have."""
    c = F.col("content")
    at = lambda i, n: number(c, i, n, little=True)
    tag = lambda i: part(c, i, F.lit(4)).cast("string")
    start = F.struct(F.lit(12).cast("long").alias("at"), F.lit(-1).cast("long").alias("format"), F.lit(-1).cast("long").alias("data"))

    def step(s, _):
        i = s["at"]
        size = at(i + 4, 4)
        here = lambda name, old: F.when((old < 0) & (tag(i) == name), i + 8).otherwise(old)
        return F.struct(F.coalesce(i + 8 + size + size % 2, i).cast("long").alias("at"), here("fmt ", s["format"]).alias("format"), here("data", s["data"]).alias("data"))

    settled = lambda rows, walk: rows.select("path", "content", F.inline(F.array(F.struct(walk.alias("x")))))
    walked = settled(files, F.aggregate(F.sequence(F.lit(1), F.lit(16)), start, step))
    more = (F.col("x.data") < 0) & (F.col("x.at") + 8 <= F.octet_length(c))
    steps = F.when(more, F.sequence(F.lit(1), (F.octet_length(c) / 8).cast("int"))).otherwise(F.array().cast("array<int>"))
    walked = settled(walked, F.aggregate(steps, F.col("x"), step))
    form, data = F.col("x.format"), F.col("x.data")
    good = (tag(F.lit(0)) == "RIFF") & (tag(F.lit(8)) == "WAVE") & (form > 0) & (data > 0) & (at(form, 2) == 1) & (at(form + 14, 2) == 16) & (at(form + 2, 2) > 0)
    error = F.when(~F.coalesce(good, F.lit(False)), "no 16-bit PCM")
    fields = F.struct(at(form + 2, 2).alias("channels"), at(form + 4, 4).alias("rate"), part(c, data, at(data - 4, 4)).alias("raw"), error.alias("error"))
    rows = walked.select("path", F.inline(F.array(fields)))
    return rows.select("path", *[F.when(F.col("error").isNull(), x).alias(n) for n, x in (("channels", F.col("channels")), ("rate", F.col("rate")), ("pcm", from_bytes(F.col("raw"))))], "error")


def to_wav(pcm, channels, rate):
    """The RIFF file of interleaved 16-bit integers, as a column."""
    from framelake.functions.pcm import to_bytes
    from framelake.functions.wire import digits

    body = to_bytes(pcm)
    size = F.octet_length(body)
    text = lambda s: F.lit(s.encode().hex().upper())
    n = lambda value, width: digits(value, width, little=True)
    head = (text("RIFF"), n(size + 36, 4), text("WAVEfmt "), n(F.lit(16), 4), n(F.lit(1), 2), n(channels, 2), n(rate, 4), n(rate * channels * 2, 4), n(channels * 2, 2), n(F.lit(16), 2), text("data"), n(size, 4))
    return F.unhex(F.concat(*head, F.hex(body)))
