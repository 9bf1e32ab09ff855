"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features are counts of byte n-grams of the lower-cased text, hashed into a fixed number of buckets, square-rooted and
scaled to length one. Executors compute them; the driver only sees those of a bounded training sample."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm._common import aside, cut, read, restored
from framelake.llm._text import U, as_bytes, mix, parts

#: Language families by ISO 639-1 code. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "baltic": ["lt", "lv"],
    "turkic": ["az", "kk", "tr", "uz"],
}
BUCKETS = 2048
ROW_BYTES = 4096  # what a row of features counts beside its text, so that a part has some hundred rows at most
UNKNOWN = "und"
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: Digits and signs say nothing about a language.
_lower[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


def features(texts: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """One row of unit length for each text (null: zeros), from the n-grams of 1 to 4 bytes of the whole text."""
    data, offsets = as_bytes(texts)
    data = _lower[data]
    n, rows = len(data), len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    out, gram = np.zeros(rows * buckets), np.zeros(n, U)
    repeated = np.zeros(n, bool)  # white space after white space
    repeated[1:] = (data[1:] == 32) & (data[:-1] == 32)
    for k in range(4):
        there = np.zeros(n, U)
        there[: n - k] = data[k:] if k else data
        gram = gram << U(8) | there
        keep = (left > k) & ~repeated & ((data != 32) | (k > 0))
        bucket = (mix(gram[keep] + U(k + 1 << 40)) % U(buckets)).astype(np.int64)
        out += np.bincount(row[keep] * buckets + bucket, minlength=rows * buckets)
    out = np.sqrt(out.reshape(rows, buckets))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def linear_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, epochs: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge linear support vector machine; y is +1 or -1, classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    weight, y = weight.astype(x.dtype), y.astype(x.dtype)
    w, velocity = np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype)
    for _ in range(epochs):
        ahead = w + 0.9 * velocity
        slack = np.maximum(0, 1 - y * (x @ ahead))
        velocity = 0.9 * velocity - 0.5 * (strength * ahead - 2 * x.T @ (weight * y * slack))
        w = w + velocity
    return w


class Hierarchy:
    """Family machines (each against the others) and, in each family, a machine for every pair of languages."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        family_of = {c: f for f, codes in FAMILIES.items() for c in codes}
        self.langs = sorted(set(lang.tolist()))
        self.family = [family_of.get(c, f"only {c}") for c in self.langs]
        self.families = sorted(set(self.family))
        code = np.array([self.langs.index(c) for c in lang], int)
        own = np.array([self.families.index(f) for f in self.family], int)[code] if len(code) else code
        self.top = [linear_svm(x, np.where(own == i, 1.0, -1.0)) for i in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = {
            (a, b): linear_svm(x[(code == a) | (code == b)], np.where(code[(code == a) | (code == b)] == a, 1.0, -1.0))
            for a, b in combinations(range(len(self.langs)), 2) if self.family[a] == self.family[b]
        }

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages, and scores from 0 to 1: how sure the family is, times the share of the pairwise votes weighted by margin."""
        squash = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -9, 9)))
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        n = len(x)
        if self.top:
            margins = x @ np.array(self.top).T
            chosen, sure = margins.argmax(1), squash(margins.max(1))
        else:
            chosen, sure = np.zeros(n, int), np.ones(n)
        votes, against = np.zeros((n, len(self.langs))), np.zeros(n)
        for (a, b), w in self.pairs.items():
            p = squash(x @ w)
            votes[:, a] += p
            votes[:, b] += 1 - p
        family = np.array([self.families.index(f) for f in self.family])
        size = np.bincount(family, minlength=len(self.families))[chosen]
        votes[family[None, :] != chosen[:, None]] = -1
        best = votes.argmax(1)
        against = np.where(size > 1, votes.max(1) / np.maximum(1, size - 1), 1.0)
        return [self.langs[i] for i in best], sure * against


def train(docs: DataFrame, per_language: int = 1000, most: int = 16_000) -> Hierarchy | None:
    """Fit on documents(doc_id, text, lang). Rows with a null text or lang teach nothing; None if none is left.

    Every value of lang with a row is learnt. The sample is bounded: at most `per_language` rows of each, those with the smallest
    hash of doc_id, and fewer where there are so many languages that all would be over `most` rows (but one each). Texts count whole.
    A first pass, over the ids and langs only, finds the share to take of each language, so no text but those of the sample is sorted."""
    usable = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    counts = cut(usable.groupBy("lang").agg(F.count("*").alias("of_lang")))  # a row for each language
    languages = counts.count()
    if not languages:
        return None
    per_language = max(1, min(per_language, most // languages))
    share = counts.withColumn("share", F.least(F.lit(1 << 30), (F.lit(1.3 * per_language + 50) / F.col("of_lang") * (1 << 30)).cast("long")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    picked = usable.join(F.broadcast(share), "lang").withColumn("draw", draw).filter(F.col("draw") < F.col("share"))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    sample = picked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("lang", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only what isn't zero: where, and how much."""
        for part in parts(batches, "text", 1 << 20, ROW_BYTES):
            x = features(part.column(1)).astype(np.float32)
            found = [np.flatnonzero(r).astype("<u2") for r in x]
            at, value = [k.tobytes() for k in found], [r[k].tobytes() for r, k in zip(x, found)]
            yield pa.record_batch([part.column(0), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["lang", "at", "value"])

    rows = sample.mapInArrow(featurise, "lang string, at binary, value binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["at"], r["value"]))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], np.float32)
    return Hierarchy(x, np.array([r["lang"] for r in rows], object))


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """documents(doc_id, text, ...) with lang_pred and score in place of text. Only the text is looked at.

    A text that is null or has no letter, and any text without a model, is `und` with score 0. Repeated rows are judged alike; an empty
    table gives an empty result. Other columns pass through, but for those named like a result."""
    columns = [c for c in docs.columns if c != "text"]
    docs = aside(docs, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in ("text", "has_letter"))
    docs = docs.withColumn("has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", 1 << 20, ROW_BYTES):
            kept = part.drop_columns(["text", "has_letter"])
            letters = part.column("has_letter").to_numpy(zero_copy_only=False)
            langs, scores = model.predict(features(part.column("text"))) if model else ([UNKNOWN] * len(letters), np.zeros(len(letters)))
            langs = [x if ok else UNKNOWN for x, ok in zip(langs, letters)]
            yield pa.record_batch([*kept.columns, pa.array(langs, pa.string()), pa.array(np.where(letters, scores, 0.0))], names=[*kept.schema.names, "lang_pred", "score"])

    return restored(docs.mapInArrow(predict, f"{fields}, lang_pred string, score double"), columns)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's predicted language, learnt from those that are not held out."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model)
