"""Joins of intervals by buckets, without a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dealt(rows: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each bucket that [start, end) touches; empty intervals and nulls touch none."""
    return rows.filter(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int, how: str = "inner") -> DataFrame:
    """Pairs of left(key, a, b) and right(key, c, d) whose intervals [a, b) and [c, d) overlap, with all columns of both; how may be `left_semi`.

    Both sides are dealt to buckets of `width`, an interval to as many as it touches, and joined by key and bucket. A pair that meets in
    several buckets counts in the one where the later of the two begins. width should be about the length of most intervals."""
    a, b = _dealt(left, "a", "b", width), _dealt(right.withColumnRenamed(key, "_key"), "c", "d", width).withColumnRenamed("_bucket", "_other")
    once = F.floor(F.greatest("a", "c") / width) == F.col("_bucket")
    meet = (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_other")) & (F.col("a") < F.col("d")) & (F.col("c") < F.col("b")) & once
    if how == "left_semi":
        return a.join(b, meet, how).drop("_bucket")
    return a.join(b, meet).drop("_bucket", "_other", "_key")


def feature_window(offset: Column, frame: Column, first: int, latents: Column, available: Column, rate: int = 48_000) -> Column:
    """Which features of a deep copy a concealed frame needs: per_frame, needed, base (the newest's number), last (the highest number there is), recoverable and missing.

    offset is how far back the frame is and `available` how far the copy's own start is, in samples; a feature lasts 10 ms, a latent four of
    them, and `first` more are needed where the synthesis begins. Numbers below 0 lie after the copy and are neither there nor missing."""
    ten = rate // 100
    per_frame = F.greatest(F.floor(frame / ten), F.lit(1))
    needed, base, last = per_frame + first, first - 2 + F.floor((offset + available) / ten), 4 * latents - 1
    low = F.greatest(F.lit(0), base - needed + 1)
    recoverable = F.greatest(F.lit(0), F.least(base, last) - low + 1)
    missing = F.greatest(F.lit(0), base - F.greatest(low, last + 1) + 1)
    names = {"per_frame": per_frame, "needed": needed, "base": base, "last": last, "recoverable": recoverable, "missing": missing}
    return F.when(frame > 0, F.struct(*[x.cast("long").alias(n) for n, x in names.items()]))
