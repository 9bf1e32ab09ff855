"""Ranked lexical search: TPUT over term-partitioned postings.

postings() writes, for each row of the documents and each of its terms that some item asks for, how often it occurs (tf) and how many terms the
row has (n). They are dealt out by term, the long list of a frequent term over several places. search() then takes three steps, each a join or a
grouping over all items at once:

1. The heads: of each term's list the HEAD highest scores. What a document has in an item's heads is a lower bound of its score; of those with the
   highest such bounds, TRIED for an item, the exact scores are looked up. The k-th highest of these is the item's first mark, since k documents
   reach it.
2. The uniform threshold: a document with a score of the mark has in one of the item's m lists at least the mark / m. All entries of half of that are fetched
   from every list (at the whole of it, what was not fetched could make up for nearly the mark itself, and few documents would be out); a list
   whose head is lower gives none. The sum of what was fetched of a document is a lower bound again, which gives the second
   mark as above; a document whose sum, with less than the threshold for every list that it was not fetched from (and no more than that list's head),
   does not reach the mark, is out.
3. The exact scores of all that are left are looked up in the lists, by term and document, and the k highest stay.

No candidate is dropped but by these bounds, so the result is exact. Integers are of 64 bits, doubles only in a term's weight."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm._common import cut, read
from framelake.llm._text import as_bytes, parts, row_of

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_inside = np.zeros(256, bool)
_inside[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPREAD = 64  # places that a term's list is dealt to
HEAD, TRIED = 20, 50  # entries of a list, documents of an item, that the first mark is taken from
DOCUMENT = ""  # in place of a term: the row of a document itself


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, lower-cased, as a dictionary array, and how many come before each row."""
    n = len(data)
    inside = np.concatenate([[False], _inside[data], [False]])
    cut_ = np.zeros(n + 1, bool)
    cut_[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut_[:-1])) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut_[1:])) + 1 if n else np.zeros(0, np.int64)
    edges = np.empty(2 * len(start) + 1, np.int64)
    edges[:-1:2], edges[1::2], edges[-1] = start, end, end[-1] if len(end) else 0
    edges[2:-1:2] = start[1:]
    # terms and the gaps between them, one after the other over the same bytes; every other slice is a term
    all_ = pa.Array.from_buffers(pa.large_binary(), max(0, 2 * len(start) - 1), [None, pa.py_buffer(edges[: max(1, 2 * len(start))].tobytes()), pa.py_buffer(_lower[data].tobytes())])
    terms = all_.take(pa.array(np.arange(0, len(all_), 2)))
    return terms.dictionary_encode(), np.searchsorted(start, offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "text", 1 << 22):
        terms, before = tokens(*as_bytes(part.column(2)))
        n, width = np.diff(before), max(1, len(terms.dictionary))
        pair, tf = np.unique(row_of(before) * width + terms.indices.to_numpy(zero_copy_only=False), return_counts=True)
        filled = np.flatnonzero(n)
        row = np.concatenate([pair // width, filled])
        words = pa.concat_arrays([terms.dictionary.cast(pa.binary()).take(pa.array(pair % width)), pa.array([b""] * len(filled), pa.binary())]).cast(pa.string())
        at = pa.array(row)
        yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), words, pa.array(np.concatenate([tf, np.zeros(len(filled), np.int64)])), pa.array(n[row])], names=["_row", "doc_id", "term", "tf", "n"])


def asked(items: DataFrame) -> DataFrame:
    """items(item_id, text) to item_id, term and repeats; items alike in both are one, null and empty texts ask for nothing."""
    rows = items.select(F.lit(0).cast("long").alias("_row"), F.col("item_id").cast("long").alias("doc_id"), "text").distinct()
    found = rows.mapInArrow(_count, "_row long, doc_id long, term string, tf long, n long").filter(F.col("term") != DOCUMENT)
    return found.groupBy(F.col("doc_id").alias("item_id"), "term").agg(F.sum("tf").alias("repeats"))


def postings(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The written lists of all terms that queries asks for: term, _row (the document's number), doc_id, tf, n; and each document with a term, under DOCUMENT.

    Every row of docs(doc_id, text) is a document of its own, also a repeated one; null texts have no term. Other columns play no part."""
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long"), "text")
    all_ = numbered.mapInArrow(_count, "_row long, doc_id long, term string, tf long, n long")
    # written, so that its size is known and Spark sends it to the documents' terms, not these to it, while it is small
    wanted = cut(queries.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([(DOCUMENT,)], "term string")))
    kept = all_.join(wanted, "term", "left_semi")
    return cut(kept.repartition("term", F.pmod("_row", F.lit(SPREAD))).sortWithinPartitions("term"))


def _highest(rows: DataFrame, group: str, score: str, k: int) -> DataFrame:
    """The k-th highest score of each group, null for fewer; each task keeps k of a group before any are shuffled."""
    ranked = rows.select(group, score, F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score))).alias("_at")).filter(F.col("_at") <= k)
    return ranked.groupBy(group).agg(F.min(F.when(F.col("_at") == k, F.col(score))).alias("mark"))


def lists(found: DataFrame) -> DataFrame:
    """The postings with each one's score under its term: term, _row, doc_id, score."""
    total = found.filter(F.col("term") == DOCUMENT).agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    weight = F.floor(1000 * F.ln(F.lit(2.0 * total["N"] + 2) / (2.0 * F.col("df") + 1))).cast("long")
    terms = found.filter(F.col("term") != DOCUMENT).groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w"))
    terms = cut(terms)
    m = F.expr(f"25 + (75 * n * {total['N']}L) div {max(1, total['L'])}L")
    score = F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))")
    return found.filter(F.col("term") != DOCUMENT).join(terms, "term").withColumn("m", m).select("term", "_row", "doc_id", score.alias("score")).filter("score > 0")


def _looked_up(pairs: DataFrame, asks: DataFrame, scored: DataFrame) -> DataFrame:
    """The exact scores of pairs(item_id, _row): item_id, _row, score, doc_id."""
    rows = pairs.select("_row").distinct()
    there = scored.join(rows, "_row", "left_semi")
    wanted = pairs.join(asks.select("item_id", "term", "repeats"), "item_id")
    return wanted.join(there, ["term", "_row"]).groupBy("item_id", "_row").agg(F.sum(F.col("score") * F.col("repeats")).alias("score"), F.first("doc_id").alias("doc_id"))


def _tried(sums: DataFrame, asks: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """For sums(item_id, _row, sum), lower bounds of scores: item_id and mark, the k-th highest of the exact scores of those with the highest bounds."""
    high = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("sum"), "_row"))
    some = cut(sums.select("item_id", "_row", high.alias("_at")).filter(F.col("_at") <= max(k, TRIED)).select("item_id", "_row"))
    return _highest(_looked_up(some, asks, scored), "item_id", "score", k)


def search(found: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring documents of each item of queries(item_id, term, repeats) over postings(): item_id, rank (from 1), doc_id, score.

    Equal scores go by ascending doc_id (null first); items with fewer documents of a score above 0 have them all, others no row."""
    scored = lists(found)
    queries = queries.withColumn("item_id", F.struct("item_id"))  # so that a null item is one like others
    best = Window.partitionBy("term").orderBy(F.desc("score"), "doc_id", "_row")
    heads = cut(scored.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= max(k, HEAD)).select("term", "_row", "score"))
    tops = heads.groupBy("term").agg(F.max("score").alias("top"))
    asks = cut(queries.join(tops, "term"))  # terms that no document has are out
    low = heads.join(asks, "term").groupBy("item_id", "_row").agg(F.sum(F.col("score") * F.col("repeats")).alias("sum"))
    marks = asks.groupBy("item_id").agg(F.count("*").alias("lists")).join(_tried(low, asks, scored, k), "item_id", "left")
    # without k documents in the heads every entry counts
    level = F.greatest(F.lit(1), F.expr("coalesce(mark, 0) div (2 * lists)")).cast("long")
    wanted = cut(asks.join(marks.select("item_id", level.alias("level")), "item_id").withColumn("most", F.least(F.col("level") - 1, F.col("top") * F.col("repeats"))))
    needs = F.expr("(level + repeats - 1) div repeats")
    reached = cut(wanted.withColumn("needs", needs).filter(F.col("top") >= F.col("needs")).select("item_id", "term", "repeats", "most", "needs"))
    least = cut(reached.groupBy("term").agg(F.min("needs").alias("least")))
    high = scored.join(least, "term").filter(F.col("score") >= F.col("least")).select("term", "_row", "score")
    # by documents first: what each gives to all items is then summed where it stands
    entries = high.repartition("_row").alias("h").join(reached.alias("x"), (F.col("h.term") == F.col("x.term")) & (F.col("h.score") >= F.col("x.needs")))
    sums = entries.groupBy("item_id", "_row").agg(F.sum(F.col("score") * F.col("repeats")).alias("sum"), F.sum("most").alias("spared"))
    limits = cut(wanted.groupBy("item_id").agg(F.sum("most").alias("all")).join(marks.select("item_id", "mark"), "item_id"))
    bound = F.col("sum") + F.col("all") - F.col("spared")
    sums = cut(sums.join(limits, "item_id").select("item_id", "_row", "sum", bound.alias("bound"), "mark").filter(F.col("bound") >= F.coalesce("mark", F.lit(0))).drop("mark"))
    last = cut(_tried(sums, asks, scored, k))
    left = sums.join(last, "item_id", "left").filter(F.col("bound") >= F.coalesce("mark", F.lit(0))).select("item_id", "_row")
    exact = _looked_up(cut(left), asks, scored)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "_row"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id.item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    queries = cut(asked(read(spark, sf_dir, "benchmark", "item_id", "text")))
    return search(postings(read(spark, sf_dir, "documents", "doc_id", "text"), queries), queries)
