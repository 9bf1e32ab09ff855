"""Packets of a stream in their order: losses, recovery, concealment, time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import packets as P
from framelake.operators.framing import low_rate_copy, parse
from framelake.operators.redundancy import add_redundancy, split_redundancy
from framelake.operators.scan import running
from framelake.sources.adapters import FRAME

JUMP = 100  # a gap of so many packets is a jump, not a loss


def lost_slots(received: DataFrame) -> DataFrame:
    """Of packets(stream_id, seq) that arrive in order, one row for each that is missing between two: stream_id, seq, ago, ts48.

    ago counts back from the packet after the gap, from 1; gaps of 100 and more are jumps."""
    rows = running(received.select("stream_id", "seq"), "stream_id", "seq", before={"_before": F.col("seq")})
    gaps = rows.select("stream_id", "seq", (F.col("seq") - F.col("_before") - 1).alias("missing")).filter((F.col("missing") > 0) & (F.col("missing") < JUMP))
    slots = gaps.select("stream_id", F.col("seq").alias("_next"), F.explode(F.sequence(F.lit(1).cast("long"), "missing")).alias("ago"))
    return slots.select("stream_id", (F.col("_next") - F.col("ago")).alias("seq"), "ago", ((F.col("_next") - F.col("ago")) * FRAME).alias("ts48"))


def recovery(sent: DataFrame, depth: int = 2, payload_type: int = 111) -> DataFrame:
    """How each lost slot is filled, the first that can: a redundant copy in a packet that came after it, the low-rate copy in the first frame of the
    next packet, or concealment.

    sent(stream_id, seq, ts, lost, payload), with timestamps of FRAME ticks a packet, is put on the wire with up to `depth` earlier payloads each;
    what came is taken apart again. Adds kind to lost_slots()."""
    arrived = sent.filter(~F.col("lost"))
    wires = add_redundancy(sent, depth, FRAME, payload_type).filter(~F.col("lost")).select("stream_id", "ts", "wire")
    carried = split_redundancy(wires, payload_type).select("stream_id", "ts", F.explode("blocks.offset").alias("offset"))
    copies = carried.select("stream_id", F.pmod(F.col("ts") - F.col("offset"), F.lit(1 << 32)).alias("_ts")).distinct().withColumn("red", F.lit(True))
    after = low_rate_copy(parse(arrived.select("stream_id", (F.col("seq") - 1).alias("seq"), "payload"))).select("stream_id", "seq", "has_copy")
    lost = lost_slots(arrived.select("stream_id", "seq")).withColumn("_ts", F.pmod("ts48", F.lit(1 << 32)))
    lost = lost.join(copies, ["stream_id", "_ts"], "left").join(after, ["stream_id", "seq"], "left")
    kind = F.when(F.col("red"), "redundant").when(F.coalesce("has_copy", F.lit(False)) & (F.col("ago") == 1), "low rate").otherwise("concealed")
    return lost.select("stream_id", "seq", "ago", "ts48", kind.alias("kind"))


def loss_runs(packets: DataFrame, decay: float = 0.57, silent: float = 0.001) -> DataFrame:
    """Add run, how many packets in a row are lost up to this one, and fade, the level of concealment after it, to packets(stream_id, seq, lost)."""
    rows = running(packets, "stream_id", "seq", last={"_good": F.when(~F.col("lost"), F.col("seq"))}, first={"_first": F.col("seq")})
    return _faded(rows, decay, silent).drop("_good", "_first")


def _faded(rows: DataFrame, decay: float = 0.57, silent: float = 0.001) -> DataFrame:
    run = F.when(F.col("lost"), F.col("seq") - F.coalesce("_good", F.col("_first") - 1)).otherwise(0).cast("long")
    fade = F.pow(F.lit(decay), F.col("run"))
    return rows.withColumn("run", run).withColumn("fade", F.when(fade < silent, 0.0).otherwise(fade))


def fill_forward(packets: DataFrame, column: str, decay: float = 0.9, floor: float = 0.2) -> DataFrame:
    """Add filled: the value of a received packet; of a lost one, the last good value times decay^run, at least `floor` of it."""
    came = ~F.col("lost")
    rows = running(packets, "stream_id", "seq", last={"_good": F.when(came, F.col("seq")), "_value": F.when(came, F.col(column))}, first={"_first": F.col("seq")})
    level = F.greatest(F.lit(floor), F.pow(F.lit(decay), F.col("run")))
    filled = F.when(F.col("lost"), F.coalesce("_value", F.lit(0.0)) * level).otherwise(F.col(column))
    return _faded(rows).withColumn("filled", filled).drop("_good", "_first", "_value")


def granules(packets: DataFrame) -> DataFrame:
    """Add granule, the samples of the stream up to and with this packet, to packets(stream_id, seq, toc, second_byte)."""
    n = F.coalesce(P.frames_lenient(F.col("toc"), F.col("second_byte")) * P.frame_samples(F.col("toc")), F.lit(0))
    return running(packets.withColumn("samples", n), "stream_id", "seq", sums={"granule": F.col("samples")})


def seek(with_granules: DataFrame, target: int) -> DataFrame:
    """The first packet of each stream at or past the target."""
    found = with_granules.filter(F.col("granule") >= target)
    return found.groupBy("stream_id").agg(F.min_by(F.struct("seq", "granule"), "seq").alias("x")).select("stream_id", "x.seq", "x.granule")


def arrivals(segments: DataFrame, lookahead: int) -> DataFrame:
    """Verdict on segments(start, length, cursor): late where they end at or before the cursor, early where they start past cursor + lookahead. Late is looked at first."""
    late, early = F.col("start") + F.col("length") <= F.col("cursor"), F.col("start") > F.col("cursor") + lookahead
    return segments.withColumn("verdict", F.when(late, "late").when(early, "early").otherwise("taken"))


def mix(segments: DataFrame, frame: int = FRAME) -> DataFrame:
    """Windows of `frame` samples over segments(start, length, gain) of constant level: window, tracks, and the sum of gain times samples within.

    A segment is dealt to the windows that it touches, so the overlap needs no range join."""
    last = F.floor((F.col("start") + F.col("length") - 1) / frame)
    dealt = segments.filter("length > 0").withColumn("window", F.explode(F.sequence(F.floor(F.col("start") / frame), last)))
    inside = F.least(F.col("start") + F.col("length"), (F.col("window") + 1) * frame) - F.greatest(F.col("start"), F.col("window") * frame)
    return dealt.groupBy("window").agg(F.count("*").alias("tracks"), F.sum(inside * F.col("gain")).alias("level"))


def regroup(packets: DataFrame, size: int = 3, most: int = P.MOST_FRAMES) -> DataFrame:
    """Join runs of `size` packets(stream_id, seq, toc, second_byte, len) into one: stream_id, part, toc, packets, frames, bytes, error.

    All must agree in all of the first byte but the frame code, and stay within 48 frames and 120 ms; else error says why."""
    toc, second = F.col("toc"), F.col("second_byte")
    n = F.coalesce(P.frames_strict(toc, second), F.lit(0))
    rows = packets.select("stream_id", F.floor(F.col("seq") / size).alias("part"), "seq", toc, "len", n.alias("frames"), (n * P.frame_samples(toc)).alias("samples"))
    out = rows.groupBy("stream_id", "part").agg(
        F.min_by("toc", "seq").alias("first_toc"), F.count("*").alias("packets"), F.sum("frames").alias("frames"), F.sum("len").alias("bytes"), F.sum("samples").alias("samples"),
        F.min(F.shiftright("toc", 2)).alias("_a"), F.max(F.shiftright("toc", 2)).alias("_b"), F.min("frames").alias("_f"),
    )
    error = F.when(F.col("_a") != F.col("_b"), "different kinds").when(F.col("_f") == 0, "invalid packet").when((F.col("frames") > most) | (F.col("samples") > P.MOST_SAMPLES), "too long")
    return out.select("stream_id", "part", "first_toc", "packets", "frames", "bytes", error.alias("error"))


def silence_suppressed(frames: DataFrame, milliseconds: float = 20) -> DataFrame:
    """Add idle, how many frames in a row have no activity up to this one, and suppressed to frames(stream_id, seq, active) of this length.

    After 200 ms of idle frames 400 ms are suppressed; then one is sent again, and so on. Any activity starts anew. A null is no activity."""
    ahead, most = round(200 / milliseconds), round(400 / milliseconds)
    busy = F.coalesce("active", F.lit(False))
    rows = running(frames, "stream_id", "seq", sums={"_row": F.lit(1).cast("long")})
    rows = running(rows, "stream_id", "seq", last={"_busy": F.when(busy, F.col("_row"))})
    rows = rows.withColumn("idle", F.when(busy, 0).otherwise(F.col("_row") - F.coalesce("_busy", F.lit(0))).cast("long"))
    refresh = (F.col("idle") > ahead + most) & ((F.col("idle") - ahead) % (most + 1) == 0)
    return rows.withColumn("suppressed", (F.col("idle") > ahead) & ~refresh).drop("_row", "_busy")
