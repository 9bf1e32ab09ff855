"""Statistics of packets and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import packets as P


def by_mode(packets: DataFrame) -> DataFrame:
    """Packets, samples and mean length by mode, bandwidth and channels."""
    toc = F.col("toc")
    kinds = packets.select(P.mode(toc).alias("mode"), P.bandwidth(toc).alias("bandwidth"), P.stereo(toc).alias("stereo"), P.frame_samples(toc).alias("s"), "len")
    return kinds.groupBy("mode", "bandwidth", "stereo").agg(F.count("*").alias("packets"), F.sum("s").alias("samples"), F.round(F.avg("len"), 6).alias("mean_len"))


def percentiles(values: DataFrame, group: str, column: str) -> DataFrame:
    """By group: n, mean, the element of floor rank 95 n / 100, the nearest-rank 95th percentile, the upper median and the geometric mean.

    Values are counted before they are ranked, so a group's rows never meet in one task; only its distinct values do."""
    counts = values.groupBy(group, F.col(column).alias("v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(group).orderBy("v")
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    n = F.col("n")
    return ranked.groupBy(group).agg(
        F.max("n").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 6).alias("mean"), at(F.least(F.floor(n * 95 / 100), n - 1)).alias("p95_floor"),
        at(F.ceil(n * 95 / 100) - 1).alias("p95"), at(F.floor(n / 2)).alias("upper_median"), F.round(F.exp(F.sum(F.ln("v") * F.col("c")) / F.max("n")), 6).alias("geomean"),
    )


def profile(pairs: DataFrame) -> DataFrame:
    """One row for aligned packets (len_a, len_b, mode_a, mode_b): mean and 95th percentile of the length difference, rate of different
    modes, and how far the two histograms of modes are apart (the sum of the differences of their shares)."""
    modes = ("silk", "hybrid", "celt")
    more = lambda m: F.sum((F.col("mode_a") == m).cast("long") - (F.col("mode_b") == m).cast("long")).alias(f"_{m}")
    d = F.abs(F.col("len_a") - F.col("len_b"))
    counts = pairs.groupBy(d.alias("d")).agg(F.count("*").alias("c"), F.count_if(F.col("mode_a") != F.col("mode_b")).alias("m"), *map(more, modes))
    ranked = counts.withColumn("upto", F.sum("c").over(Window.orderBy("d"))).withColumn("n", F.sum("c").over(Window.partitionBy()))  # some hundred rows
    return ranked.agg(
        F.max("n").alias("n"), F.round(F.sum(F.col("d") * F.col("c")) / F.max("n"), 6).alias("mean_difference"),
        F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * 95 / 100), F.col("d"))).alias("p95_difference"), F.round(F.sum("m") / F.max("n"), 6).alias("mode_mismatch"),
        F.round(sum((F.abs(F.sum(f"_{m}")) for m in modes[1:]), F.abs(F.sum("_silk"))) / F.max("n"), 6).alias("histogram_distance"),
    )


def mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """For two lists of packets(stream_id, seq, payload): how many places of a stream both have, at how many the payloads differ, and the
    first such place (-1: none)."""
    pairs = left.select("stream_id", "seq", F.col("payload").alias("_a")).join(right.select("stream_id", "seq", F.col("payload").alias("_b")), ["stream_id", "seq"])
    bad = ~F.col("_a").eqNullSafe(F.col("_b"))
    return pairs.groupBy("stream_id").agg(F.count("*").alias("compared"), F.count_if(bad).alias("mismatches"), F.coalesce(F.min(F.when(bad, F.col("seq"))), F.lit(-1)).alias("first_mismatch"))


def compare_blocks(pairs: DataFrame) -> DataFrame:
    """For pairs(block_id, a, b) of sample arrays, over their common length: correlation, ratio of root mean squares, rmse, snr in dB.

    Both constant: correlation 1; one constant: 0. No error: snr 120."""
    z = F.arrays_zip(F.col("a").alias("a"), F.col("b").alias("b"))
    both = F.slice(z, F.lit(1), F.least(F.size("a"), F.size("b")))
    total = lambda f: F.aggregate("z", F.lit(0.0), lambda s, p: s + f(p["a"].cast("double"), p["b"].cast("double")))
    rows = pairs.withColumn("z", both).select(
        "block_id", F.size("z").alias("n"), total(lambda a, b: a).alias("sa"), total(lambda a, b: b).alias("sb"), total(lambda a, b: a * a).alias("saa"), total(lambda a, b: b * b).alias("sbb"),
        total(lambda a, b: a * b).alias("sab"), total(lambda a, b: (a - b) * (a - b)).alias("sdd"),
    )
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n"), F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    corr = F.when((va <= 1e-12) & (vb <= 1e-12), 1.0).when((va <= 1e-12) | (vb <= 1e-12), 0.0).otherwise((F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb))
    snr = F.when(F.col("sdd") == 0, 120.0).otherwise(10 * F.log10(F.col("saa") / F.col("sdd")))
    return rows.filter("n > 0").select(
        "block_id", F.round(corr, 4).alias("correlation"), F.round(F.sqrt(F.col("sbb") / F.col("saa")), 4).alias("rms_ratio"), F.round(F.sqrt(F.col("sdd") / F.col("n")), 4).alias("rmse"), F.round(snr, 3).alias("snr"),
    )


def lowest(rows: DataFrame, score: str, name: str, n: int) -> DataFrame:
    """A report of the n rows with the least score, ties by name."""
    return rows.orderBy(score, name).limit(n)
