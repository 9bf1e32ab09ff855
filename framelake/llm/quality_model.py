"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade g in 0..K-1 follows P(g >= j) = sigmoid(s - theta_j) with thresholds theta_1 < ... < theta_(K-1); the
score s = w . x is shared by all thresholds. x marks which hashed words (lower case, without the signs around them), and
which hashed sign runs around words, a text has at least once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._common import read
from framelake.llm._text import U, as_bytes, parts, prefix, row_of, slices, words

BUCKETS = 1 << 16
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_sign = np.zeros(256, bool)
_sign[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text, ascending, and how many come before each row. Null and empty texts have none."""
    data, offsets = as_bytes(texts)
    start, end, before = words(data, offsets)
    rows = row_of(before)
    shouted = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    capitals = (shouted[end] - shouted[start] > 2) & (small[end] == small[start])
    data = _lower[data]
    sign = np.concatenate([_sign[data], [False]])
    run = np.arange(len(data) + 1)  # where the run of signs that holds a byte ends, and where it begins
    ahead = np.minimum.accumulate(np.where(sign, len(data), run)[::-1])[::-1]
    back = np.maximum.accumulate(np.where(sign, -1, run))
    a = np.minimum(ahead[start], end)
    b = np.maximum(back[end - 1] + 1, a)
    h = prefix(data)
    core, tail, lead = (a < b), (b < end), (start < a)
    salt = [U(0x1234567), U(0x89ABCDEF), U(0xFEDCBA98), U(0x777777777)]
    codes = [slices(h, a, b)[core] ^ salt[0], slices(h, b, end)[tail] ^ salt[1], slices(h, start, a)[lead] ^ salt[2], np.full(int(capitals.sum()), 99, U) ^ salt[3]]
    code = np.concatenate(codes)
    row = np.concatenate([rows[core], rows[tail], rows[lead], rows[capitals]])
    flat = np.unique(row * buckets + ((code >> U(20)) % U(buckets)).astype(np.int64))
    return flat % buckets, np.searchsorted(flat, np.arange(len(offsets)) * buckets)


def likelihood(score: np.ndarray, theta: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted log-likelihood of grades under scores and thresholds, and its gradients by the scores and by the thresholds."""
    n, i = len(grade), np.arange(len(grade))
    up = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -50, 50)))  # P(grade >= j)
    edge = np.hstack([np.ones((n, 1)), up, np.zeros((n, 1))])
    d = np.hstack([np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))])
    p = np.maximum(edge[i, grade] - edge[i, grade + 1], 1e-9)
    by_theta = [(np.where(grade == j, -d[:, j] / p, 0) + np.where(grade == j - 1, d[:, j] / p, 0)).dot(weight) for j in range(1, len(theta) + 1)]
    return float(np.log(p).dot(weight)), (d[i, grade] - d[i, grade + 1]) / p * weight, np.array(by_theta)


class CumulativeLink:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, cols: np.ndarray, before: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1..K-1, a row for each text."""
        total = np.concatenate([[0.0], np.cumsum(self.weights[cols])])
        score = total[before[1:]] - total[before[:-1]]
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))

    @classmethod
    def fit(cls, cols: np.ndarray, before: np.ndarray, grade: np.ndarray, grades: int, buckets: int = BUCKETS, rounds: int = 300, strength: float = 2e-5, least: int = 3, evidence: float = 12.0):
        """Maximum likelihood with a ridge, by Nesterov steps on all rows at once.

        Buckets that are rare (below `least` rows), or whose presence shifts no threshold's rate by a likelihood ratio of
        `evidence`, get weight 0: what is left are words that tell grades apart, not the noise of thousands that don't."""
        n, rows = len(grade), row_of(before)
        seen = np.bincount(cols, minlength=buckets).astype(float)
        useful = np.zeros(buckets, bool)
        for j in range(1, grades):
            y = (grade >= j).astype(float)
            k = np.bincount(cols, weights=y[rows], minlength=buckets)
            p, rate = k / np.maximum(seen, 1), min(max(y.mean(), 1e-6), 1 - 1e-6)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = 2 * (np.where(k > 0, k * np.log(p / rate), 0) + np.where(seen > k, (seen - k) * np.log((1 - p) / (1 - rate)), 0))
            useful |= (gain > evidence) & (seen >= least)
        keep = useful[cols]
        cols, rows = cols[keep], rows[keep]
        number = np.cumsum(useful) - 1
        c, m = number[cols], int(useful.sum())
        scale = 1 / np.sqrt(np.maximum(np.bincount(c, minlength=m), 1) / n)  # rare words learn as fast as frequent ones
        scale = np.minimum(scale, 30)
        share = np.array([(grade >= j).mean() for j in range(1, grades)]).clip(1e-3, 1 - 1e-3)
        theta = -np.log(share / (1 - share)) + np.arange(grades - 1) * 1e-6
        w, v, tv = np.zeros(m), np.zeros(m), np.zeros(grades - 1)
        balance = np.zeros(n)
        for g in range(grades):
            balance[grade == g] = 1 / max(1, (grade == g).sum()) / grades
        step = 2.0
        for _ in range(rounds):
            look, lt = w + 0.9 * v, theta + 0.9 * tv
            score = np.bincount(rows, weights=(look * scale)[c], minlength=n)
            _, slope, gt = likelihood(score, lt, grade, balance)
            grad = np.bincount(c, weights=slope[rows], minlength=m) * scale
            v = 0.9 * v + step * 0.05 * (grad - strength * look)
            tv = 0.9 * tv + step * 0.2 * gt
            w, theta = w + v, np.maximum.accumulate(theta + tv + np.arange(grades - 1) * 1e-9)
        weights = np.zeros(buckets)
        weights[useful] = w * scale
        return cls(weights, theta)


def train(rated: DataFrame, grades: int, most: int = 12_000) -> CumulativeLink | None:
    """Fit on rated(doc_id, text, grade); rows with a null grade teach nothing, a null text is empty, repeated rows each count. None if no row is left; other columns play no part.

    The sample is bounded: at most about `most` rated rows, those with the smallest hash of doc_id; texts count whole."""
    rated = rated.filter("grade is not null")
    n = rated.agg(F.count("*").alias("n")).first()["n"]
    if not n:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, most / n) * (1 << 30)))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", 1 << 20):
            cols, before = features(part.column(0))
            yield pa.record_batch([part.column(1), pa.array([cols[a:b].astype("<u4").tobytes() for a, b in zip(before, before[1:])], pa.binary())], names=["grade", "x"])

    rows = rated.filter(draw).select("text", F.col("grade").cast("int")).mapInArrow(featurise, "grade int, x binary").collect()
    rows.sort(key=lambda r: (r["grade"], r["x"]))
    x = [np.frombuffer(r["x"], "<u4").astype(np.int64) for r in rows]
    if not x:
        return None
    return CumulativeLink.fit(np.concatenate(x), np.concatenate([[0], np.cumsum([len(r) for r in x])]), np.array([r["grade"] for r in rows], int), grades)


def score(docs: DataFrame, model: CumulativeLink | None, grades: int) -> DataFrame:
    """documents(doc_id, text) to doc_id, expected_grade and tails, where tails[j-1] = P(grade >= j). Without a model all are null; a null or empty text
    has the score 0. Repeated rows are scored alike, an empty table gives an empty result, other columns play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", 1 << 20):
            n = part.num_rows
            tails = model.tails(*features(part.column(1))) if model else None
            listed = pa.array(tails.tolist() if model else [None] * n, pa.list_(pa.float64()))
            yield pa.record_batch([part.column(0), pa.array(tails.sum(1) if model else [None] * n, pa.float64()), listed], names=["doc_id", "expected_grade", "tails"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Grades of all documents: 0 toxic, 1 harmless but poor, 2 harmless and good. kept: P(grade >= 1) and P(grade >= 2) are a half or more."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = train(docs.join(labels.select("doc_id", grade.alias("grade")), "doc_id"), 3)
    p = lambda j: F.col("tails")[j - 1]
    return score(docs, model, 3).select("doc_id", "expected_grade", p(1).alias("p_harmless"), p(2).alias("p_good"), F.coalesce((p(1) >= 0.5) & (p(2) >= 0.5), F.lit(False)).alias("kept"))
