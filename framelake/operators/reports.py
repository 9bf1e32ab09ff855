"""Reports on measurements, and comparisons of signals that are shifted against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.scan import affine, scan, then


def violations(measured: DataFrame, guards: DataFrame, name: str, value: str, limit: str) -> DataFrame:
    """Guards that do not hold: name, the median of the measured values, the limit and why (`missing` or `above`)."""
    found = measured.groupBy(name).agg(F.median(value).alias("median"))
    rows = guards.join(found, name, "left")
    why = F.when(F.col("median").isNull(), "missing").when(F.col("median") > F.col(limit), "above")
    return rows.withColumn("why", why).filter("why is not null").select(name, "median", limit, "why")


def quality(error: Column) -> Column:
    """Of an internal error: 100 for none, 0 where it is about 0.277."""
    return 100 * (1 - 0.5 * F.ln(1 + error) / F.ln(F.lit(1.13)))


def failed_bars(q: Column, correlation: Column, ratio: Column, least_q: float, least_correlation: float, low: float, high: float) -> Column:
    """Names of the limits that a comparison misses; a limit of 0 is none but for that of q."""
    return F.array_compact(F.array(
        F.when(q < least_q, "q"), F.when((correlation < least_correlation) & F.lit(least_correlation > 0), "correlation"),
        F.when((ratio < low) & F.lit(low > 0), "quiet"), F.when((ratio > high) & F.lit(high > 0), "loud"),
    ))


#: Weights of lost and deeply recovered percent, of copies of both kinds and of concealed milliseconds (divided), and what each may add at most.
LOSS_WEIGHT, DEEP_WEIGHT, COPY_WEIGHT, CONCEALED_PER_POINT = 1.2, 0.30, 0.5, 120
MOST_LOSS, MOST_DEEP, MOST_COPY, MOST_CONCEALED, NO_ERROR = 40, 30, 15, 15, 10.0


def resilience(loss_percent: Column, deep_percent: Column, red: Column, fec: Column, concealed_ms: Column, errors: Column) -> Column:
    """A score of 0 to 100 for how well losses are made up for, each part of it bounded."""
    bound = lambda x, most: F.least(F.lit(float(most)), x)
    parts = (
        bound(loss_percent * LOSS_WEIGHT, MOST_LOSS), bound(deep_percent * DEEP_WEIGHT, MOST_DEEP), bound(red * COPY_WEIGHT, MOST_COPY), bound(fec * COPY_WEIGHT, MOST_COPY),
        bound(concealed_ms / CONCEALED_PER_POINT, MOST_CONCEALED), F.when(errors == 0, NO_ERROR).otherwise(0.0),
    )
    return F.round(bound(sum(parts[1:], parts[0]), 100)).cast("int")


def smoothed(rows: DataFrame, group: str, order: str, value: str, out: str, keep: float = 0.65) -> DataFrame:
    """Add the running mean that keeps this share of itself at each step; where it is 0, it starts anew from the value. Values are of one sign; order
    numbers a group's rows densely."""
    return scan(rows, group, order, affine(keep, F.col(value)), then, out).withColumn(out, F.col(out)["fresh"])


def correlation_at(a: Column, b: Column, lag: Column, skip: int = 0) -> Column:
    """Uncentred correlation of a from its lag-th sample on with b (a negative lag moves b), over what both have, without every
    skip-th place; 0 where a signal is silent there."""
    i0, j0 = F.greatest(lag, F.lit(0)), F.greatest(-lag, F.lit(0))
    n = F.least(F.size(a) - i0, F.size(b) - j0)
    pairs = F.arrays_zip(F.slice(a, i0 + 1, F.greatest(n, F.lit(0))).alias("x"), F.slice(b, j0 + 1, F.greatest(n, F.lit(0))).alias("y"))
    pairs = F.filter(pairs, lambda p, k: k % skip != 0) if skip else pairs
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p["x"].cast("double"), p["y"].cast("double")))
    power = total(lambda x, y: x * x) * total(lambda x, y: y * y)
    return F.when(power > 0, total(lambda x, y: x * y) / F.sqrt(power)).otherwise(0.0)


def best_delay(pairs: DataFrame, most: int, stride: int) -> DataFrame:
    """For pairs(block_id, a, b) the delay within `most` at which they correlate best, ties to the smaller one: first in strides, then
    around the best of those: block_id, delay, correlation."""

    def best(rows: DataFrame, delays: Column) -> DataFrame:
        each = rows.withColumn("_d", F.explode(delays)).withColumn("_c", correlation_at(F.col("a"), F.col("b"), F.col("_d")))
        return each.groupBy("block_id").agg(F.max_by(F.struct("_d", "_c"), F.struct("_c", -F.abs("_d"), -F.col("_d"))).alias("best"))

    coarse = best(pairs, F.sequence(F.lit(-most), F.lit(most), F.lit(stride)))
    near = lambda d: F.sequence(F.greatest(F.lit(-most), d - stride), F.least(F.lit(most), d + stride))
    fine = best(pairs.join(coarse, "block_id"), near(F.col("best._d")))
    return fine.select("block_id", F.col("best._d").alias("delay"), F.col("best._c").alias("correlation"))
