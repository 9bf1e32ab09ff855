"""Scans over rows in their order, with no task that needs a whole group.

A group is cut into slices by a value that ascends with its order. Within a slice a window or a fold does the work; what a slice leaves behind
for the next ones is a row of a carry table, which is scanned in turn and joined back. One group with a third of all rows is so spread over
as many tasks as it has slices. Null groups are groups like others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.shared import written

ROWS = 1 << 16  # of a slice, about
WIDTH = 256  # rows that one fold takes


def joined(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of carry, by keys that may be null."""
    named = carry.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(named, match, "left").drop(*(f"_of_{k}" for k in keys))


def running(
    rows: DataFrame, group: str, order: str | list[str], sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, before: dict[str, Column] | None = None,
    first: dict[str, Column] | None = None, at: Column | None = None, most: int = ROWS,
) -> DataFrame:
    """Add to each row, over its group's rows up to it: sums, the last value that isn't null, the first such; and the last one before it.

    at is a number that ascends with the order (the order itself, if not given): rows with the same at // most are a slice, so numbers without
    wide gaps make slices of `most` rows. Of rows with equal order any may come first. rows are read twice, for the slices and for the carry table:
    write them first, where working them out is dear."""
    order = [order] if isinstance(order, str) else order
    place = F.struct(*order)
    wanted = [(kind, name, x) for kind, some in (("sum", sums), ("last", last), ("before", before), ("first", first)) for name, x in (some or {}).items()]
    rows = rows.withColumn("_slice", F.floor((F.col(order[0]) if at is None else at) / most))
    within = Window.partitionBy(group, "_slice").orderBy(*order)
    upto, ahead = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    there = lambda x: F.when(x.isNotNull(), place)
    whole = {"sum": F.sum, "last": lambda x: F.max_by(x, there(x)), "before": lambda x: F.max_by(x, there(x)), "first": lambda x: F.min_by(x, there(x))}
    over = {"sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True), "before": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True)}
    inside = {"sum": lambda x: F.sum(x).over(upto), "last": lambda x: F.last(x, ignorenulls=True).over(upto), "before": lambda x: F.last(x, ignorenulls=True).over(ahead), "first": lambda x: F.first(x, ignorenulls=True).over(upto)}
    carry = rows.groupBy(group, "_slice").agg(*[whole[kind](x).alias(f"_c_{name}") for kind, name, x in wanted])
    carry = carry.select(group, "_slice", *[over[kind](F.col(f"_c_{name}")).over(earlier).alias(f"_c_{name}") for kind, name, _ in wanted])
    local = rows.withColumns({f"_l_{name}": inside[kind](x) for kind, name, x in wanted})
    out = joined(local, carry, [group, "_slice"])
    made = {}
    for kind, name, _ in wanted:
        a, b = F.col(f"_c_{name}"), F.col(f"_l_{name}")
        made[name] = F.coalesce(a + b, a, b) if kind == "sum" else F.coalesce(a, b) if kind == "first" else F.coalesce(b, a)
    return out.withColumns(made).drop("_slice", *(f"_{k}_{name}" for k in "cl" for _, name, _ in wanted))


def fitting(rows: DataFrame, group: str, at: Column, most: int = ROWS) -> int:
    """A width of slices of a whole-numbered `at` such that none of any group has more than `most` rows, unless more of them are alike in it.

    Counts group and slice only: the first width would do if rows were spread evenly; where they come in bursts, it shrinks and they are counted again."""
    seen = rows.select(group, at.cast("long").alias("_at"))
    n, low, high = seen.agg(F.count("*"), F.min("_at"), F.max("_at")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * most // max(1, n))
    while n > most and width > 1:
        worst = seen.groupBy(group, F.floor(F.col("_at") / width)).count().agg(F.max("count")).first()[0]
        if worst <= most:
            break
        width = max(1, width * most // (2 * worst))
    return width


def numbered(rows: DataFrame, group: str, order: list[str], at: Column, out: str = "seq", most: int = ROWS) -> DataFrame:
    """Number each group's rows from 0 in their order, which begins with `at`, a whole number that may have gaps and bursts."""
    width = fitting(rows, group, at, most)
    return running(rows, group, order, sums={out: F.lit(1).cast("long")}, at=at.cast("long"), most=width).withColumn(out, F.col(out) - 1)


def with_before(rows: DataFrame, group: str, place: str, n: int, column: Column, out: str, most: int = ROWS) -> DataFrame:
    """Add the values of column in the n rows before each, oldest first, as an array; place numbers a group's rows densely.

    The last n rows of a slice also stand at the head of the next, so no carry is needed."""
    own = F.floor(F.col(place) / most)
    twice = F.when(F.col(place) % most >= most - n, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("_v", column).withColumn("_slice", F.explode(twice))
    past = Window.partitionBy(group, "_slice").orderBy(place).rowsBetween(-n, -1)
    return dealt.withColumn(out, F.collect_list("_v").over(past)).filter(F.col("_slice") == own).drop("_v", "_slice")


def scan(rows: DataFrame, group: str, place: str, value: Column, combine: Callable[[Column, Column], Column], out: str, width: int = WIDTH, levels: int = 3) -> DataFrame:
    """Add what an associative combine(earlier, later) makes of all values of the group up to each row; place numbers a group's rows densely.

    Each stretch of `width` rows is folded by itself; the totals of stretches are written, and are rows that are scanned in the same way, `levels` - 1 times more
    (16 million rows of a group with three), and the last time in one fold. combine must not be given to values that hang on the group's start."""
    rows = rows.withColumn("_v", value)
    stretch = F.floor(F.col(place) / width) if levels > 1 else F.lit(0).cast("long")
    listed = rows.groupBy(group, stretch.alias("_s")).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("_p"), F.col("_v").alias("_v"), F.struct(*rows.columns).alias("_row")))).alias("_l"))
    none = F.slice(F.transform("_l", lambda x: x["_v"]), F.lit(1), F.lit(0))
    longer = lambda s, x: F.concat(s, F.array(F.when(F.size(s) == 0, x["_v"]).otherwise(combine(F.element_at(s, F.lit(-1)), x["_v"]))))
    folded = listed.withColumn("_f", F.aggregate("_l", none, longer))
    folded = folded.select(group, "_s", F.col("_l._row").alias("_rows"), "_f")
    if levels > 1:
        totals = written(folded.select(group, "_s", F.element_at("_f", F.lit(-1)).alias("_t")), "scan")
        scanned = scan(totals, group, "_s", F.col("_t"), combine, "_all", width, levels - 1)
        # what all earlier stretches make is the total up to the one before this
        carry = scanned.select(group, (F.col("_s") + 1).alias("_s"), F.col("_all").alias("_carry"))
        folded = joined(folded, carry, [group, "_s"])
        folded = folded.withColumn("_f", F.when(F.col("_carry").isNull(), F.col("_f")).otherwise(F.transform("_f", lambda x: combine(F.col("_carry"), x)))).drop("_carry")
    return folded.select(F.inline(F.arrays_zip("_rows", "_f"))).select("_rows.*", F.col("_f").alias(out)).drop("_v")


def affine(keep: float, x: Column) -> Column:
    """A step of a running mean that keeps this share of itself, as scan() takes it: what it makes of a state of 0, which starts anew, and of any other."""
    x = x.cast("double")
    return F.struct(x.alias("fresh"), F.lit(keep).alias("times"), (x * (1 - keep)).alias("plus"))


def then(f: Column, g: Column) -> Column:
    """Two such steps as one."""
    fresh = F.when(f["fresh"] == 0, g["fresh"]).otherwise(g["times"] * f["fresh"] + g["plus"])
    return F.struct(fresh.alias("fresh"), (f["times"] * g["times"]).alias("times"), (g["times"] * f["plus"] + g["plus"]).alias("plus"))


def followed(f: Column, g: Column) -> Column:
    """Two steps of a machine with finitely many states as one; a step is the array of the states that follow each state."""
    return F.transform(f, lambda s: F.get(g, s))
