"""Near-duplicate documents by DartMinHash signatures and banding.

Darts are thrown at a plane whose width is weight and whose height is rank: in every unit of weight of an element, and in
each band of ranks, a hash of the element draws how many darts hit and where. Of the darts inside an element's region,
weight by rank, each is hashed to a coordinate of the signature, and a coordinate keeps the earliest. Equal elements of two
sets have equal darts, so a coordinate agrees with the probability of their weighted Jaccard similarity; few darts beyond
the signature's length are ever looked at, however large the set. A shingle's weight is how often its text has it.

Equal texts are one representative from the start. Documents that agree in a band are linked to the band's least, the
links' components bound what can be similar, and within a component exact similarities decide: a search from document to
document that follows every pair at or above the threshold. In components too large for one task, links to hubs first join
clusters; what is outside the largest is cut into blocks that meet the blocks of all other clusters, so no link is missed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._common import cut, read
from framelake.llm._text import U, as_bytes, mix, numbered, parts, row_of, shingles
from framelake.llm.components import components

BLOCK_BYTES = 1 << 15
LOWEST = -7  # the first band of ranks ends at 2^LOWEST, each next one at twice the one before


def _poisson_table(area: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson variable of this mean, as thresholds of a 64-bit uniform."""
    out, p, total, k = [], math.exp(-area) if area < 700 else 0.0, 0.0, 0
    if not p:
        raise ValueError("a band of ranks is too tall")
    while total < 1 - 1e-15 and k < area + 12 * math.sqrt(area) + 40:
        total += p
        out.append(min(total, 1 - 2**-53))
        k += 1
        p *= area / k
    return (np.array(out) * 2.0**64).astype(U)


_tables: dict[int, np.ndarray] = {}


def dart_minhash(element: np.ndarray, weight: np.ndarray | None, before: np.ndarray, k: int) -> np.ndarray:
    """Signatures of k 64-bit values for rows of weighted elements; before: elements before each row. An empty row has zeros.

    A weight of 2.5 is the layers 0, 1 and 2, of which the last counts darts on its first half only. None: all weights 1."""
    rows, row = len(before) - 1, row_of(before)
    if weight is None:
        layer, share = np.zeros(len(element), U), None
        total = np.diff(before).astype(float)
    else:
        total = np.bincount(row, weights=weight, minlength=rows)
        layers = np.ceil(weight).astype(np.int64)
        own = np.repeat(np.arange(len(element)), layers)
        layer = (np.arange(len(own)) - np.repeat(np.cumsum(layers) - layers, layers)).astype(U)
        element, row, share = element[own], row[own], np.minimum(1.0, weight[own] - layer.astype(float))
    seed = mix(element + layer * U(0xA0761D6478BD642F))
    height = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-9), 0)
    top = np.maximum(0, np.ceil(np.log2(np.maximum(height, 1e-9))) - LOWEST).astype(int)  # the last band that a row needs at first
    rank, value = np.full(rows * k, np.inf), np.zeros(rows * k, U)
    open_ = total > 0
    band = 0
    while open_.any():
        low, high = (0.0 if band == 0 else 2.0 ** (band - 1 + LOWEST)), 2.0 ** (band + LOWEST)
        pieces = max(1, int((high - low) / 256))  # of a tall band, so that a Poisson table stays short
        for piece in range(pieces):
            area = (high - low) / pieces
            key = hash(area)
            if key not in _tables:
                _tables[key] = _poisson_table(area)
            live = np.flatnonzero(open_[row])
            if not len(live):
                break
            draw = mix(seed[live] ^ U((band << 20 | piece) * 0x9E3779B97F4A7C15 % 2**64))
            hit = draw >= _tables[key][0]
            live, draw = live[hit], draw[hit]
            number = np.searchsorted(_tables[key], draw, "right")
            own = np.repeat(live, number)
            j = np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number)
            dart = mix(np.repeat(draw, number) ^ seed[own] + (j.astype(U) + U(1)) * U(0xE7037ED1A0B428DB))
            if share is not None:
                inside = (mix(dart ^ U(0x8EBC6AF09C88C6E3)) >> U(11)).astype(float) * 2.0**-53 < share[own]
                own, dart = own[inside], dart[inside]
            cell = row[own] * k + ((dart >> U(32)) * U(k) >> U(32)).astype(np.int64)
            at = low + area * (piece + (mix(dart ^ U(0x589965CC75374CC3)) >> U(11)).astype(float) * 2.0**-53)
            empty = rank[cell] > low + area * piece  # earlier bands can't be beaten
            cell, at, dart = cell[empty], at[empty], dart[empty]
            np.minimum.at(rank, cell, at)
            won = rank[cell] == at
            value[cell[won]] = dart[won]
        band += 1
        waiting = np.isinf(rank.reshape(rows, k)).any(1)
        open_ = (total > 0) & ((top >= band) | waiting)
    return value.reshape(rows, k)


def signatures(docs: DataFrame, bands: int = 32, per_band: int = 6, words: int = 5, weighted: bool = True) -> DataFrame:
    """documents(doc_id, text) to doc_id, content (hash of the text), load (what the text weighs in a block) and keys: one for each band;
    none for a text without words. weighted: a shingle weighs as often as the text has it; else 1."""
    k = bands * per_band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", 1 << 20):
            sets, before, count = shingles(*as_bytes(part.column(3)), words)
            n = part.num_rows
            values = dart_minhash(sets, count.astype(float) if weighted else None, before, k).reshape(n, bands, per_band)
            keys = np.arange(bands, dtype=U)[None, :] * U(0x2545F4914F6CDD1D)
            for i in range(per_band):
                keys = mix(keys ^ values[:, :, i])
            some = np.diff(before) > 0
            offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1).view(np.int64)))
            yield pa.record_batch([*part.columns[:3], listed], names=["doc_id", "content", "load", "keys"])

    load = (1 + F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / BLOCK_BYTES)).cast("long")
    columns = (F.col("doc_id").cast("long"), content().alias("content"), load.alias("load"), "text")
    return docs.select(*columns).mapInArrow(run, "doc_id long, content binary, load long, keys array<long>")


def content() -> Column:
    """The hash that tells texts apart; a null text is empty."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def _sets(texts: pa.Array, words: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text, as sets in which common items count as the similarity has it: (items, items before each row)."""
    sets, before, count = shingles(*as_bytes(texts), words)
    return numbered(sets, before, count) if weighted else (sets, before)


def similar_pairs(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that connect all rows which pairs of Jaccard similarity at or above the threshold connect, and no others.

    A search: each row reached is compared with all rows not reached yet."""
    size = np.array([len(s) for s in sets])
    codes, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum(size)])
    waiting, links = np.flatnonzero(size > 0), []
    mark = np.zeros(len(codes), bool)
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            i = queue.pop()
            near = waiting[(size[waiting] >= threshold * size[i]) & (size[waiting] * threshold <= size[i])]
            if not len(near):
                continue
            mark[flat[edges[i] : edges[i + 1]]] = True
            length = size[near]
            first = np.cumsum(length) - length
            at = np.arange(int(length.sum())) - np.repeat(first - edges[near], length)
            both = np.add.reduceat(mark[flat[at]].astype(np.int64), first)
            mark[flat[edges[i] : edges[i + 1]]] = False
            found = near[both >= threshold * (length + size[i] - both) - 1e-9]
            if len(found):
                links += [(i, int(j)) for j in found]
                queue += found.tolist()
                waiting = waiting[~np.isin(waiting, found)]
    return links


def _near(pairs: DataFrame, threshold: float, words: int, weighted: bool) -> DataFrame:
    """Of pairs(a, b, text_a, text_b), those with a similarity at or above the threshold: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text_a", 1 << 19):
            left, right = (_sets(part.column(i), words, weighted) for i in (2, 3))
            keep = []
            for i in range(part.num_rows):
                x, y = (h[e[i] : e[i + 1]] for h, e in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _blocks(texts: DataFrame, groups: DataFrame, hubs: DataFrame, threshold: float, words: int, block: int, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """For components(node, load, root) too large for one task: the blocks that still have to meet, and the links that need no meeting.

    Each text is first compared with the one hub that it shares most bands with, which joins nearly all of a large group of copies
    into one cluster, in linear work. Blocks of one cluster needn't meet any more; the few texts outside the largest meet all."""
    best = hubs.join(groups.select(F.col("node").alias("a")).hint("merge"), "a").groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    pairs = best.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    known = cut(_near(pairs, threshold, words, weighted))
    found = components(known).select("node", F.col("root").alias("cluster"))
    nodes = cut(groups.join(found.hint("merge"), "node", "left").withColumn("cluster", F.coalesce("cluster", "node")))
    size = nodes.groupBy("root", "cluster").agg(F.sum("load").alias("m"))
    big = size.filter(F.col("m") > block)
    rest = size.filter(F.col("m") <= block).groupBy("root").agg(F.sum("m").alias("m")).withColumn("cluster", F.lit(-1).cast("long"))
    heaps = cut(big.unionByName(rest).select("root", "cluster", F.ceil(F.col("m") / block).alias("blocks"), "m"))
    named = lambda k: F.xxhash64("root", "cluster", k)
    each = heaps.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.select("root", "cluster", "m", named(F.col("k")).alias("mine"))
    largest = heaps.filter("cluster >= 0").groupBy("root").agg(F.max_by("cluster", F.struct("m", "cluster")).alias("largest"))
    movers = each.join(largest.hint("merge"), "root", "left").filter(~F.col("cluster").eqNullSafe(F.col("largest"))).select("root", F.col("cluster").alias("c"), F.col("mine").alias("other"))
    meet = each.join(movers.hint("merge"), "root").filter((F.col("cluster") != F.col("c")) | (F.col("cluster") == -1)).select("mine", "other")
    meet = meet.union(meet.select("other", "mine")).distinct()
    own = nodes.join(big.select("root", F.col("cluster").alias("cluster"), F.lit(True).alias("own")).hint("merge"), ["root", "cluster"], "left")
    own = own.withColumn("cluster", F.when(F.col("own"), F.col("cluster")).otherwise(-1)).join(heaps.select("root", "cluster", "blocks").hint("merge"), ["root", "cluster"])
    mine = own.select("node", "root", named(F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("mine"))
    return mine.join(meet.hint("merge"), "mine").select("node", "root", "mine", "other"), known


def members(docs: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 32, per_band: int = 6, block: int = 2000, weighted: bool = True) -> DataFrame:
    """documents(doc_id, text) to doc_id, content (SHA-256 of the text), class (a number) and class_id, the least doc_id of the class, null
    where no document of it has an id; a row for each row.

    A class is what links of Jaccard similarity at or above the threshold connect, of the multisets (weighted) or the sets of word shingles;
    equal texts are always together. Texts without words are alike only if equal; a null text is empty; rows with the same doc_id are one document
    and bring their texts' classes together. An empty table gives no row; other columns play no part. block: how many texts, of up
    to BLOCK_BYTES bytes each, or as much in longer ones, a task compares with each other. With 32 bands of 6, a pair at 0.8 shares no band once in 16,000."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = cut(signatures(docs, bands, per_band, words, weighted))
    same = signed.groupBy("content").agg(F.min("doc_id").alias("least"), F.max("load").alias("load"), F.first("keys").alias("keys"))
    same = cut(same.withColumn("node", F.monotonically_increasing_id()))  # written, so the numbers stay
    keyed = cut(same.select("node", F.explode("keys").alias("key")))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    hubs = keyed.join(shared, "key").filter("node <> least").groupBy(F.col("node").alias("a"), F.col("least").alias("b")).agg(F.count("*").alias("n"))
    hubs = cut(hubs)
    groups = cut(components(hubs.select("a", "b")).join(same.select("node", "load", "content", "least").hint("merge"), "node"))
    wanted = groups.select("node", F.col("content").alias("c"), "least")
    # one row of each text that has company; written before equal rows are dropped, so that many of them are split among tasks
    listed = docs.withColumn("content", content())
    listed = cut(listed.join(wanted.hint("merge"), (F.col("content") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "text"))
    texts = listed.dropDuplicates(["node"])
    large = cut(groups.groupBy("root").agg(F.sum("load").alias("m")).filter(F.col("m") > block).select("root"))
    placed, known = groups.select("node", "root", F.lit(0).alias("mine"), F.lit(0).alias("other")), None
    if not large.isEmpty():
        small = placed.join(large.hint("merge"), "root", "left_anti")
        wide, known = _blocks(texts, groups.select("node", "load", "root").join(large.hint("merge"), "root"), hubs, threshold, words, block, weighted)
        placed = small.unionByName(wide)
    placed = placed.select("node", "root", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    meeting = texts.join(placed.hint("merge"), "node").select("node", "root", "low", "high", "text")

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        sets, before = _sets(pa.array(frame["text"].tolist(), pa.large_string()), words, weighted)
        node = frame["node"].to_numpy()
        pairs = similar_pairs([sets[a:b] for a, b in zip(before, before[1:])], threshold)
        return pd.DataFrame({"a": [node[i] for i, _ in pairs], "b": [node[j] for _, j in pairs]}, dtype="int64")

    found = meeting.groupBy("root", "low", "high").applyInPandas(link, "a long, b long")
    if known is not None:
        found = found.union(known)
    nodes = same.select("content", "node", "least")
    own = cut(signed.select("doc_id", "content").join(nodes.hint("merge"), "content"))
    several = own.filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("doc_id", "a")
    merged = own.join(several.hint("merge"), "doc_id").filter("node <> a").select(F.col("node").alias("b"), "a").distinct()  # a doc_id with several texts
    roots = components(cut(found).union(merged.select("a", "b")))
    classed = nodes.join(roots.hint("merge"), "node", "left").withColumn("class", F.coalesce("root", "node"))
    classed = cut(classed.select("node", "class", "least"))
    named = cut(classed.groupBy("class").agg(F.min("least").alias("class_id")))
    return own.select("doc_id", "content", "node").join(classed.select("node", "class").hint("merge"), "node").join(named.hint("merge"), "class").select("doc_id", "content", "class", "class_id")


def classes(docs: DataFrame, **options) -> DataFrame:
    """documents(doc_id, text) to doc_id and class_id, as members() has them: a row for each doc_id, however many rows have it, and one for
    each row without an id."""
    found = members(docs, **options)
    return found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id")).union(found.filter("doc_id is null").select("doc_id", "class_id"))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Class of every document: five-word shingles, similarity 0.8 or more."""
    return classes(read(spark, sf_dir, "documents", "doc_id", "text"))
