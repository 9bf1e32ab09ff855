"""Chunks of signals: cut anew into frames, clipped softly across their borders, and two long signals compared without either standing in one value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.scan import running
from framelake.sources.shared import written


def placed(chunks: DataFrame, group: str) -> DataFrame:
    """chunks(group, seq, pcm) with _start, the samples of the group before each; null chunks are empty."""
    rows = chunks.withColumn("pcm", F.coalesce("pcm", F.expr("array()").cast("array<double>"))).withColumn("_n", F.size("pcm").cast("long"))
    return running(rows, group, "seq", sums={"_end": F.col("_n")}).withColumn("_start", F.col("_end") - F.col("_n"))


def frames(chunks: DataFrame, group: str, size: int, flush: bool = True) -> DataFrame:
    """chunks(group, seq, pcm) of any lengths to frames of `size` samples: group, frame (from 0), pcm. What is left at the end is filled up with zeros, or left out without flush.

    Places come from running sums; each chunk is dealt to the frames that it touches, and a frame is put together from what touches it."""
    rows = placed(chunks, group).filter("_n > 0")
    touched = F.sequence(F.floor(F.col("_start") / size), F.floor((F.col("_end") - 1) / size))
    dealt = rows.withColumn("frame", F.explode(touched))
    begin = F.greatest(F.lit(0).cast("long"), F.col("frame") * size - F.col("_start"))
    end = F.least(F.col("_n"), (F.col("frame") + 1) * size - F.col("_start"))
    piece = F.slice("pcm", (begin + 1).cast("int"), (end - begin).cast("int"))
    whole = dealt.groupBy(group, "frame").agg(F.array_sort(F.collect_list(F.struct((F.col("_start") + begin).alias("at"), piece.alias("x")))).alias("_x"))
    pcm = F.flatten(F.transform("_x", lambda p: p["x"]))
    out = whole.select(group, "frame", pcm.alias("pcm"))
    if not flush:
        return out.filter(F.size("pcm") == size)
    return out.withColumn("pcm", F.concat("pcm", F.array_repeat(F.lit(0.0), size - F.size("pcm"))))


def lag_sums(pairs: DataFrame, group: str, size: int, lags: list[int]) -> DataFrame:
    """Of two signals, chunks(group, seq, a, b, mask) of equal lengths for both, by group and lag: n, sab, saa, sbb and sdd over all places i of b, unless masked, for which a
    has i + lag: sums of products, squares and squared differences.

    Both are cut into frames of `size` samples; a frame of b meets the frames of a that it needs, so a task holds two frames' reach. The sums of
    frames are added up by group. A mask that is false leaves its place of b out; a null mask is none."""
    reach = -(-max(map(abs, lags)) // size)
    a = frames(pairs.select(group, "seq", F.col("a").alias("pcm")), group, size)
    length = pairs.groupBy(group).agg(F.sum(F.size("a")).cast("long").alias("_len"))
    seen = F.coalesce("mask", F.transform("b", lambda _: F.lit(True)))
    b = frames(pairs.select(group, "seq", F.col("b").alias("pcm")), group, size)
    m = frames(pairs.select(group, "seq", F.transform(seen, lambda x: F.when(x, 1.0).otherwise(0.0)).alias("pcm")), group, size)
    near = a.select(group, F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.col("frame") + k)).alias("_to"), F.col("frame").alias("_from"), F.col("pcm").alias("_a"))
    ahead = near.groupBy(F.col(group).alias("_g"), "_to").agg(F.collect_list(F.struct("_from", "_a")).alias("_as"))
    rows = b.join(m.select(F.col(group).alias("_mg"), F.col("frame").alias("_mf"), F.col("pcm").alias("_m")), F.col(group).eqNullSafe(F.col("_mg")) & (F.col("frame") == F.col("_mf")))
    rows = rows.join(ahead, F.col(group).eqNullSafe(F.col("_g")) & (F.col("frame") == F.col("_to"))).join(length.withColumnRenamed(group, "_lg"), F.col(group).eqNullSafe(F.col("_lg")))
    rows = rows.select(group, "frame", F.col("pcm").alias("b"), "_m", "_as", "_len")
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in (group, "lag", "n", "sab", "saa", "sbb", "sdd")}
            for row in batch.to_pylist():
                wide = np.zeros((2 * reach + 1) * size)
                for piece in row["_as"]:
                    at = (piece["_from"] - row["frame"] + reach) * size
                    wide[at : at + size] = piece["_a"]
                y, mask = np.array(row["b"], float), np.array(row["_m"]) > 0
                first = row["frame"] * size
                places = first + np.arange(size)
                for lag in lags:
                    here = mask & (places < row["_len"]) & (places + lag >= 0) & (places + lag < row["_len"])
                    p, q = wide[reach * size + lag : reach * size + lag + size][here], y[here]
                    for k, v in zip(out, (row[group], lag, len(q), p @ q, p @ p, q @ q, (p - q) @ (p - q))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(group, batch.schema.field(group).type), ("lag", pa.int32()), ("n", pa.int64()), *((k, pa.float64()) for k in ("sab", "saa", "sbb", "sdd"))]))

    sums = rows.mapInArrow(run, f"`{group}` {kind}, lag int, n long, sab double, saa double, sbb double, sdd double")
    return sums.groupBy(group, "lag").agg(*[F.sum(c).alias(c) for c in ("n", "sab", "saa", "sbb", "sdd")])


def compared(sums: DataFrame) -> DataFrame:
    """lag_sums() with correlation (0 where a signal is silent), rmse and snr in dB (120 without an error)."""
    power = F.col("saa") * F.col("sbb")
    corr = F.when(power > 0, F.col("sab") / F.sqrt(power)).otherwise(0.0)
    snr = F.when(F.col("sdd") == 0, 120.0).otherwise(10 * F.log10(F.col("saa") / F.col("sdd")))
    return sums.filter("n > 0").withColumns({"correlation": corr, "rmse": F.sqrt(F.col("sdd") / F.col("n")), "snr": snr})


def best_lag(rows: DataFrame, group: str) -> DataFrame:
    """Of compared() by group: the lag with the highest correlation, ties to the least in size, then to the positive."""
    best = F.max_by(F.struct("lag", "correlation", "rmse", "snr"), F.struct("correlation", -F.abs("lag"), "lag"))
    return rows.groupBy(group).agg(best.alias("x")).select(group, "x.*")


def delay_candidates(estimate: Column, most: int) -> Column:
    """Delays worth a full comparison, in the order in which they are tried: all within `most` up to 32; else 0, the estimate, its negative, and up to 8 on either side of both. Distinct, 35 at most."""
    if most <= 32:
        return F.sequence(F.lit(-most), F.lit(most))
    near = [x for d in range(1, 9) for x in (estimate - d, estimate + d, -estimate - d, -estimate + d)]
    return F.filter(F.array_distinct(F.array(F.lit(0), estimate.cast("int"), (-estimate).cast("int"), *[x.cast("int") for x in near])), lambda d: F.abs(d) <= most)


def _clip(x: np.ndarray, a: float) -> tuple[np.ndarray, float]:
    """One channel of a chunk through a quadratic knee at +-1, and the knee that is open at its end; a is the one open at its start."""
    x = np.clip(x.astype(np.float32), -2, 2)
    n = len(x)
    if not n or (a == 0 and np.all(np.abs(x) <= 1)):
        return x, 0.0 if n else a
    a = np.float32(a)
    against = np.flatnonzero(x * a >= 0)
    upto = against[0] if len(against) else n
    x[:upto] += a * x[:upto] * x[:upto]
    head, at = x[0], 0
    while True:
        over = np.flatnonzero(np.abs(x[at:]) > 1)
        if not len(over):
            return x, 0.0
        i = at + over[0]
        side = np.sign(x[i])
        turned_back, turned = np.flatnonzero(side * x[:i] < 0), np.flatnonzero(side * x[i:] < 0)
        start, end = (turned_back[-1] + 1 if len(turned_back) else 0), (i + turned[0] if len(turned) else n)
        peak = i + int(np.argmax(np.abs(x[i:end])))
        top = np.abs(x[peak])
        a = (top - 1) / (top * top)
        a = np.float32(-side * (a + a * np.float32(2.4e-7)))
        x[start:end] += a * x[start:end] * x[start:end]
        if start == 0 and peak >= 2 and side * head >= 0:
            # the chunk begins within the knee: what was played before ends at `head`, so the jump there fades out up to the peak
            gap = head - x[0]
            fade = gap - np.cumsum(np.full(peak - at, gap / peak, np.float32))
            x[at:peak] = np.clip(x[at:peak] + fade, -1, 1)
        at = end
        if at == n:
            return x, float(a)


CLIPPED = "clipped array<float>, _open array<float>"


def soft_clip(chunks: DataFrame, group: str, channels: int = 1, rounds: int = 64) -> DataFrame:
    """Add clipped to chunks(group, seq, pcm) of interleaved channels: limited to +-2, and then bent by a quadratic knee so that none is above 1; a knee that is open at a chunk's end goes on in the next.

    All chunks are first clipped as if nothing were open before them; a chunk before which something is open is clipped again with it, and so on while what a chunk leaves
    open changes: as many rounds as a knee has chunks, which is two where signals cross zero in every chunk. seq numbers a group's chunks densely. Null chunks are empty."""
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pcm, opens = batch.column(batch.schema.get_field_index("pcm")).to_pylist(), batch.column(batch.schema.get_field_index("_in")).to_pylist()
            clipped, left = [], []
            for x, a in zip(pcm, opens):
                x = np.array([] if x is None else x, np.float32)
                whole = x[: len(x) // channels * channels].reshape(-1, channels)
                done = [_clip(whole[:, c], a[c]) for c in range(channels)]
                clipped.append(np.concatenate([np.stack([d[0] for d in done], 1).ravel(), x[len(whole) * channels :]]).tolist())
                left.append([d[1] for d in done])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clipped, pa.list_(pa.float32())), pa.array(left, pa.list_(pa.float32()))], names=[*batch.schema.names, "clipped", "_open"])

    schema = ", ".join([*given, "_in array<float>", CLIPPED])
    zero = F.array_repeat(F.lit(0.0).cast("float"), channels)
    rows = written(chunks.withColumn("_in", zero).mapInArrow(kernel, schema), "soft-clip")
    for _ in range(rounds):
        prior = rows.select(F.col(group).alias("_g"), (F.col("seq") + 1).alias("_s"), F.col("_open").alias("_before"))
        linked = rows.join(prior, F.col(group).eqNullSafe(F.col("_g")) & (F.col("seq") == F.col("_s")), "left").withColumn("_before", F.coalesce("_before", zero)).drop("_g", "_s")
        stale = ~F.col("_before").eqNullSafe(F.col("_in"))
        if linked.filter(stale).isEmpty():
            return rows.drop("_in", "_open")
        again = linked.filter(stale).select(*chunks.columns, F.col("_before").alias("_in")).mapInArrow(kernel, schema)
        rows = written(linked.filter(~stale).drop("_before").unionByName(again), "soft-clip")
    raise ValueError(f"a knee is open over more than {rounds} chunks")
