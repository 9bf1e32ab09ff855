"""Sharding: indivisible groups of documents into a fixed number of shards of near-equal bytes.

The law is best-fit-decreasing bin packing. A group is all documents with the same text. Large groups are items
of their own; the many small ones are first packed, by the same law inside hash cells on the executors, into
parcels of bounded size. Groups and parcels together are at most a few times `parcels` items, whatever the
corpus: those the driver sorts by size and drops, each, into the bin with the tightest remaining capacity that
still takes it, found in a balanced tree. The capacity is the smallest with which the bins suffice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._common import aside, cut, read, restored, slots


class RoomTree:
    """A balanced search tree of (room, bin): a treap whose priorities are a fixed hash of the bin, so runs repeat exactly."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _rank(bin_: int) -> int:
        return (bin_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64)

    def _split(self, node, key):
        """Trees of what is below the key and what isn't."""
        if node is None:
            return None, None
        k, left, right = node
        if k < key:
            a, b = self._split(right, key)
            return (k, left, a), b
        a, b = self._split(left, key)
        return a, (k, b, right)

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if self._rank(a[0][1]) > self._rank(b[0][1]):
            return (a[0], a[1], self._join(a[2], b))
        return (b[0], self._join(a, b[1]), b[2])

    def add(self, room: int, bin_: int) -> None:
        a, b = self._split(self.root, (room, bin_))
        self.root = self._join(self._join(a, ((room, bin_), None, None)), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (room, bin) with room for the size, or None."""
        node, found = self.root, None
        while node is not None:
            if node[0][0] >= size:
                found, node = node[0], node[1]
            else:
                node = node[2]
        if found:
            a, rest = self._split(self.root, found)
            _, b = self._split(rest, (found[0], found[1] + 1))
            self.root = self._join(a, b)
        return found


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item; sizes are in decreasing order. None if more than `most` bins would be needed."""
    tree, out, n = RoomTree(), [], 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            if size > capacity or (most is not None and n == most):
                return None
            found, n = (capacity, n), n + 1
        out.append(found[1])
        tree.add(found[0] - size, found[1])
    return out


def into_bins(sizes: list[int], bins: int) -> list[int]:
    """A bin of each item (sizes in decreasing order), with bins of near-equal sums.

    An item of a fair share or more gets a bin of its own, and the share of the others is taken anew; the rest go by
    best fit with the smallest capacity that suffices, found by bisection."""
    whole, total = 0, sum(sizes)
    while bins - whole > 1 and whole < len(sizes) and sizes[whole] * (bins - whole) >= total:
        total -= sizes[whole]
        whole += 1
    rest, left = sizes[whole:], bins - whole
    if not rest:
        return [i % bins for i in range(len(sizes))]
    low, high, best = max(-(-total // left), rest[0]), max(-(-total // left), rest[0]) + rest[0], None
    while best is None:
        best = best_fit_decreasing(rest, high, left)
        high = high if best else high * 2
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(rest, middle, left)
        if found:
            high, best = middle, found
        else:
            low = middle + 1
    return [*range(whole), *(whole + b for b in best)]


def pack_groups(groups: DataFrame, shards: int, parcels: int = 2048, cell_rows: int = 50_000) -> DataFrame:
    """Put groups(group, bytes) into shards: the group and its shard. Groups must be distinct; an empty table gives none.

    parcels: how many parcels a fair shard holds at least, so the shards differ by about 1/parcels of their size."""
    groups = cut(groups.select("group", F.col("bytes").cast("long")))
    stats = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    size = max(1, stats["b"] // (shards * parcels))
    cells = max(1, min(-(-stats["n"] // cell_rows), shards * parcels))  # so that their last, open parcels are few as well

    def wrap(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "group"], ascending=[False, True])
        frame["parcel"] = best_fit_decreasing(frame["bytes"].tolist(), size)
        return frame.assign(cell=key[0])[["group", "bytes", "cell", "parcel"]]

    small = groups.filter(F.col("bytes") <= size).withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells)))
    wrapped = small.groupBy("cell").applyInPandas(wrap, "group binary, bytes long, cell long, parcel long")
    large = groups.filter(F.col("bytes") > size).select("group", "bytes", F.lit(-1).cast("long").alias("cell"), F.xxhash64("group").alias("parcel"))
    items = cut(wrapped.unionByName(large))
    listed = items.groupBy("cell", "parcel").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "cell", "parcel").collect()
    placed = into_bins([r["bytes"] for r in listed], shards)
    where = items.sparkSession.createDataFrame([(r["cell"], r["parcel"], b) for r, b in zip(listed, placed)], "cell long, parcel long, shard int")
    return items.join(where, ["cell", "parcel"]).select("group", "shard")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """documents(doc_id, text, ...) with size, shard and slot in place of text. Equal texts share a shard; null counts as an empty text.

    size is the text's UTF-8 bytes plus 1; slot numbers a shard's rows from 0. Repeated rows are separate rows, and an empty table
    gives none. Other columns pass through, but for those named like a result."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    others = [c for c in docs.columns if c != "text"]
    slim = aside(docs, "doc_id", "text").withColumn("size", F.octet_length(data).cast("long") + 1).withColumn("group", F.unhex(F.sha2(data, 256))).drop("text")
    slim = cut(slim)
    groups = slim.groupBy("group").agg(F.sum("size").alias("bytes"))
    placed = slim.join(pack_groups(groups, shards), "group").drop("group")
    return restored(slots(cut(placed.withColumn("_number", F.monotonically_increasing_id())), "shard", "slot"), others)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near-equal bytes; groups of equal texts are never split."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    digest = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return shard(docs.withColumn("text_crc32", digest)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"),
    )
