"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order, and posted in the inverted file of each with its place there. Rows are
dealt into blocks of bounded size, each with pivots of its own. A query reads the files of its own nearest pivots: what two orders
have in common takes 2 * (m - the larger place) off their footrule distance for each pivot, so the sums over the files rank the block's
rows by that distance. The nearest are reranked by exact inner product, and each block passes on its best. Blocks of queries meet
blocks of rows, so no task and no message grows with the table."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm._common import cut, read


def usable(vectors: DataFrame) -> DataFrame:
    """Rows of vectors(vec_id, embedding) that can take part: ids and components not null, all finite, not all zero; with their dimension."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col("embedding")
    good = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    return good.select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("embedding"), F.size(v).alias("dimension")).dropDuplicates()


class Block:
    """The index of one block of distinct vectors."""

    def __init__(self, vectors: np.ndarray, pivots: int, nearest: int):
        self.vectors = vectors
        chosen = np.random.default_rng(0).permutation(len(vectors))[:pivots]
        self.pivots, self.m = vectors[chosen], min(nearest, len(chosen))
        near = self.order(vectors)
        place = np.tile(np.arange(self.m, dtype=np.int32), len(vectors))
        by_pivot = np.argsort(near.reshape(-1), kind="stable")
        self.row, self.place = by_pivot // self.m, place[by_pivot]
        self.start = np.searchsorted(near.reshape(-1)[by_pivot], np.arange(len(chosen) + 1))

    def order(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-(x @ self.pivots.T), axis=1, kind="stable")[:, : self.m]

    def nearest(self, order: np.ndarray, take: int) -> np.ndarray:
        """The rows with the least footrule distance to this order of pivots."""
        n = len(self.vectors)
        if take >= n:
            return np.arange(n)
        common = np.zeros(n, np.int32)
        for j, pivot in enumerate(order.tolist()):
            a, b = self.start[pivot], self.start[pivot + 1]
            common[self.row[a:b]] += self.m - np.maximum(self.place[a:b], j)  # a row stands once in a file
        return np.argpartition(-common, take - 1)[:take]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 128, nearest: int = 48, width: float = 3.5, block_rows: int = 16_384, exact: bool = False) -> DataFrame:
    """The k nearest rows of vectors for each of queries, by inner product: query_id, rank, vec_id, score.

    Both have vec_id and embedding; other columns play no part, and an empty table gives no row. A query's own row is no candidate; ties
    go to the smaller vec_id; fewer candidates than k all come. Vectors of several dimensions are compared with their own kind. Repeated
    rows count once, and a vec_id with several vectors once, with its best score. Equal vectors of a block are one entry of its index. Of
    a block with n entries the nearest width * sqrt(k * n) by footrule are compared exactly; exact: all."""
    vectors, queries = cut(usable(vectors)), cut(usable(queries))

    def best_of(block: Block, ids: list[np.ndarray], query: int, vector: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(ids)
        take = n if exact else min(n, math.ceil(width * math.sqrt(k * n)))
        while True:
            near = block.nearest(order, take)
            value = np.einsum("ij,j->i", block.vectors[near], vector)
            rank = np.argsort(-value, kind="stable")
            for top in (k + 1, 4 * k, take):  # entries share ids where an id has several vectors, so more may be needed
                cut_off = value[rank[min(top, take) - 1]]
                some = rank[: np.searchsorted(-value[rank], -cut_off, "right")]  # with all ties
                found = np.concatenate([ids[near[i]][: k + 1] for i in some])
                score = np.concatenate([np.full(min(len(ids[near[i]]), k + 1), value[i]) for i in some])
                by_id = np.lexsort((-score, found))
                by_id = by_id[(found[by_id] != query) & np.append(True, np.diff(found[by_id]) != 0)]
                if len(by_id) >= k:
                    break
            if len(by_id) >= k or take == n:
                found, score = found[by_id], score[by_id]
                best = np.lexsort((found, -score))[:k]
                return found[best], score[best]
            take = n

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            left, right = left.sort_values("vec_id", kind="stable"), right.sort_values("vec_id", kind="stable")
            distinct, group = np.unique(np.array(left["embedding"].tolist(), float), axis=0, return_inverse=True)
            group = group.reshape(-1)
            by_group = np.argsort(group, kind="stable")
            ids = np.split(left["vec_id"].to_numpy()[by_group], np.searchsorted(group[by_group], np.arange(1, len(distinct))))
            block, asked = Block(distinct, pivots, nearest), np.array(right["embedding"].tolist(), float)
            for query, vector, order in zip(right["vec_id"].tolist(), asked, block.order(asked)):
                found, score = best_of(block, ids, query, vector, order)
                out["query_id"] += [query] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    count = lambda df, n: df.groupBy("dimension").agg(F.count("*").alias(n))
    blocks, parts = F.ceil(F.col("n") / block_rows), F.ceil(F.col("q") * 4 / block_rows)
    sizes = cut(count(vectors, "n").join(count(queries, "q"), "dimension").select("dimension", blocks.alias("blocks"), parts.alias("parts")))  # a row for each dimension
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("long")
    rows = vectors.join(sizes, "dimension").withColumn("block", dealt("blocks")).withColumn("part", upto("parts"))
    asked = queries.join(sizes, "dimension").withColumn("part", dealt("parts")).withColumn("block", upto("blocks"))
    key = ["dimension", "block", "part"]
    pick = lambda df: df.select(*key, "vec_id", "embedding").groupBy(key)
    found = pick(rows).cogroup(pick(asked)).applyInPandas(match, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_approximate_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest other rows of every vector whose id is divisible by 20."""
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
