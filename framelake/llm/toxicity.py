"""Toxicity: a bidirectional gated recurrent network with attention pooling, over words and their characters, in numpy.

A text's terms (lower-cased runs of letters, digits and bytes above 127) are read in windows of WINDOW terms, each starting STRIDE behind the one
before, so every term but those at the ends is in two. A term's input is its word's vector, if the word is in the vocabulary, beside the
mean vector of its characters (each byte with its neighbours, hashed). In each window two gated recurrent layers run over the inputs, one
each way; attention weighs their states, and the weighted mean gives the window's logit. A text's score is its highest
window's, brought to a probability by a line fitted on whole texts.

The model is fitted on a bounded sample (`per_class` labelled rows of each label; of each the windows with the strongest words and one by lot). Then
executors score every window of every text. A null or empty text has one window without terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm._common import cut, read
from framelake.llm._text import U, as_bytes, mix, parts, row_of
from framelake.llm.lexical import tokens

WINDOW, STRIDE = 32, 16
SIZE, HIDDEN = 8, 8  # of a vector, of a layer's state
GRAMS = 4096
LONGEST = 4096  # bytes of a window that may be taught
AT_ONCE = 4096  # windows that run side by side


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed characters of each word, each with its neighbours, and how many come before each word."""
    data, offsets = as_bytes(words)
    wide = np.zeros(len(data) + 2, U)
    wide[1:-1] = data
    before, here, after = wide[:-2].copy(), wide[1:-1], wide[2:].copy()
    before[offsets[:-1][np.diff(offsets) > 0]] = 0
    after[offsets[1:][np.diff(offsets) > 0] - 1] = 0
    return (mix(before << U(16) | here << U(8) | after) % U(GRAMS)).astype(np.int64), offsets


def mean_of(table: np.ndarray, items: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The mean of the table's rows for each group of items; zeros for an empty group."""
    total = np.zeros((len(items) + 1, table.shape[1]))
    np.cumsum(table[items], axis=0, out=total[1:])
    return (total[before[1:]] - total[before[:-1]]) / np.maximum(np.diff(before), 1)[:, None]


def windows(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First term, number of terms and text of all windows of texts with so many terms before each."""
    n = np.diff(before)
    many = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    row = np.repeat(np.arange(len(n)), many)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return before[row] + at, np.clip(n[row] - at, 0, WINDOW), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -60, 60)))


def initial(words: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters before training; word 0 stands for all that aren't in the vocabulary."""
    r = np.random.default_rng(seed)
    small = lambda *shape, by=0.1: r.normal(0, by, shape)
    bias = np.zeros(6 * HIDDEN)
    return {
        "word": small(words + 1, SIZE), "gram": small(GRAMS, SIZE), "input": small(2 * SIZE, 6 * HIDDEN, by=0.3), "bias": bias, "state": small(2, HIDDEN, 3 * HIDDEN, by=0.3),
        "attention": small(2 * HIDDEN, by=0.3), "out": small(2 * HIDDEN, by=0.3), "level": np.zeros(1),
    }


def forward(p: dict[str, np.ndarray], gates: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Logits of windows from their terms' gates (windows, WINDOW, 6 * HIDDEN; reset, update and new, one way and then the other) and mask.

    keep: with what backward() needs."""
    n, steps, h = len(gates), gates.shape[1], HIDDEN
    states = np.zeros((steps, n, 2 * h), gates.dtype)
    kept: dict = {"resets": {}, "updates": {}, "news": {}, "olds": {}, "inner": {}}
    for way in range(2):
        at, s = slice(way * h, way * h + h), np.zeros((n, h), gates.dtype)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            g, inner = gates[:, t, way * 3 * h : (way + 1) * 3 * h], s @ p["state"][way]
            both = _sigmoid(g[:, : 2 * h] + inner[:, : 2 * h])
            reset, update = both[:, :h], both[:, h:]
            new = 2 * _sigmoid(2 * (g[:, 2 * h :] + reset * inner[:, 2 * h :])) - 1
            if keep:
                for name, x in zip(kept, (reset, update, new, s, inner[:, 2 * h :])):
                    kept[name][way, t] = x
            s = s + mask[:, t, None] * (1 - update) * (new - s)
            states[t, :, at] = s
    a = np.where(mask.T > 0, states @ p["attention"], gates.dtype.type(-1e9))
    a = np.exp(a - a.max(0))
    a /= a.sum(0)
    pooled = (a[:, :, None] * states).sum(0)
    return pooled @ p["out"] + p["level"][0], kept | {"states": states, "a": a, "pooled": pooled, "mask": mask}


def backward(p: dict[str, np.ndarray], kept: dict, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters behind the gates, and of the gates, from those of the logits."""
    states, a, pooled, mask, h = kept["states"], kept["a"], kept["pooled"], kept["mask"], HIDDEN
    steps, n = a.shape
    by = {"out": pooled.T @ slope, "level": np.array([slope.sum()]), "state": np.zeros_like(p["state"])}
    d_pooled = slope[:, None] * p["out"]
    d_states = a[:, :, None] * d_pooled
    d_a = (states * d_pooled).sum(2)
    d_a = a * (d_a - (a * d_a).sum(0))
    by["attention"] = np.einsum("tn,tnk->k", d_a, states)
    d_states = d_states + d_a[:, :, None] * p["attention"]
    d_gates = np.zeros((n, steps, 6 * h))
    for way in range(2):
        at, d = slice(way * h, way * h + h), np.zeros((n, h))
        for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
            reset, update, new, old, inner = (kept[x][way, t] for x in ("resets", "updates", "news", "olds", "inner"))
            d = d + d_states[t, :, at]
            m = mask[:, t, None] * d
            d_new = m * (1 - update) * (1 - new * new)
            d_update = m * (old - new) * update * (1 - update)
            d_reset = d_new * inner * reset * (1 - reset)
            d_gates[:, t, way * 3 * h : (way + 1) * 3 * h] = np.hstack([d_reset, d_update, d_new])
            d_inner = np.hstack([d_reset, d_update, d_new * reset])
            by["state"][way] += old.T @ d_inner
            d = d - m * (1 - update) + d_inner @ p["state"][way].T
    return by, d_gates


@dataclass
class Network:
    """Vocabulary, parameters, and the line from a text's highest logit to its probability's."""

    words: pa.Array
    p: dict[str, np.ndarray]
    line: tuple[float, float] = (1.0, 0.0)

    def gates(self, terms: pa.Array) -> np.ndarray:
        """The gates' inputs for each of these terms, and for none at the end."""
        known = pc.fill_null(pc.index_in(terms.cast(pa.large_binary()), value_set=self.words), -1).to_numpy(zero_copy_only=False) + 1
        x = np.hstack([self.p["word"][known], mean_of(self.p["gram"], *grams(terms))])
        return np.vstack([x @ self.p["input"] + self.p["bias"], np.zeros(6 * HIDDEN)]).astype(np.float32)

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logit of each window, its first term within its text, and its text."""
        terms, before = tokens(*as_bytes(texts))
        table, code = self.gates(terms.dictionary), terms.indices.to_numpy(zero_copy_only=False)
        code = np.append(code, len(table) - 1).astype(np.int64)
        start, n, row = windows(before)
        p, steps, out = {k: v.astype(np.float32) for k, v in self.p.items()}, np.arange(WINDOW), []
        for i in range(0, len(start), AT_ONCE):
            mask = steps[None, :] < n[i : i + AT_ONCE, None]
            places = np.where(mask, start[i : i + AT_ONCE, None] + steps, len(code) - 1)
            out.append(forward(p, table[code[places]], mask.astype(np.float32))[0])
        return np.concatenate(out) if out else np.zeros(0, np.float32), start - before[row], row

    def probability(self, highest: np.ndarray) -> np.ndarray:
        return _sigmoid(self.line[0] * highest.astype(float) + self.line[1])


def fit(windows_: list[list[str]], label: np.ndarray, words: list[str], evidence: np.ndarray, epochs: int = 6, rate: float = 0.01, at_once: int = 256, dropped: float = 0.3, seed: int = 7) -> Network:
    """Train on windows of terms. A word's vector starts from its evidence; words are left to their characters at random (`dropped`), labels weigh the same."""
    model = Network(pa.array([w.encode() for w in words], pa.large_binary()), initial(len(words), seed))
    p, r = model.p, np.random.default_rng(seed)
    p["word"][1:, 0] += evidence
    if not len(label) or label.min() == label.max():
        p["out"][:], p["level"][0] = 0, 0.0 if not len(label) else 4.0 * (2 * label[0] - 1)
        return model
    flat = pa.array([t for w in windows_ for t in w], pa.string()).dictionary_encode()
    known = pc.fill_null(pc.index_in(flat.dictionary.cast(pa.large_binary()), value_set=model.words), -1).to_numpy(zero_copy_only=False) + 1
    item, item_before = grams(flat.dictionary)
    size = np.array([len(w) for w in windows_])
    mask = np.arange(WINDOW) < size[:, None]
    code = np.full(mask.shape, 0, np.int64)
    code[mask] = flat.indices.to_numpy(zero_copy_only=False)
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(label))
        for i in range(0, len(order), at_once):
            rows = order[i : i + at_once]
            used, local = np.unique(code[rows], return_inverse=True)
            local, m = local.reshape(len(rows), WINDOW), mask[rows].astype(float)
            word = np.where(r.random(len(used)) < dropped, 0, known[used])
            counts = item_before[used + 1] - item_before[used]
            many = np.repeat(np.arange(len(used)), counts)
            places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(item_before[used], counts)
            local_before = np.concatenate([[0], np.cumsum(counts)])
            x = np.hstack([p["word"][word], mean_of(p["gram"], item[places], local_before)])
            table = x @ p["input"] + p["bias"]
            logit, kept = forward(p, table[local], m, keep=True)
            slope = weight[rows] * (_sigmoid(logit) - label[rows]) / len(rows)
            by, d_gates = backward(p, kept, slope)
            d_table = np.zeros_like(table)
            np.add.at(d_table, local[mask[rows]], d_gates[mask[rows]])
            by["input"], by["bias"] = x.T @ d_table, d_table.sum(0)
            d_x = d_table @ p["input"].T
            by["word"], by["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
            np.add.at(by["word"], word, d_x[:, :SIZE])
            np.add.at(by["gram"], item[places], (d_x[:, SIZE:] / np.maximum(counts, 1)[:, None])[many])
            step += 1
            for k, g in by.items():
                g = g + 1e-5 * p[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def line_through(logit: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (0 at least) and level of the logistic line through these, by Newton steps with a slight ridge."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        q = _sigmoid(a * logit + b)
        v = np.maximum(q * (1 - q), 1e-6)
        g = np.array([((q - label) * logit).sum() + 0.1 * (a - 1), (q - label).sum() + 0.1 * b])
        h = np.array([[(v * logit * logit).sum() + 0.1, (v * logit).sum()], [(v * logit).sum(), v.sum() + 0.1]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = max(0.0, a - move[0]), b - move[1]
    return float(a), float(b)


def _evidence(counts: list, most: int) -> tuple[list[str], np.ndarray]:
    """Vocabulary of (word, texts of label 0, of label 1) and how far each word speaks for label 1: the log-odds of its label where a likelihood-ratio test sees any."""
    if not counts:
        return [], np.zeros(0)
    word, n0, n1 = [c[0] for c in counts], np.array([c[1] for c in counts], float), np.array([c[2] for c in counts], float)
    share = (n1.sum() + 1) / (n0.sum() + n1.sum() + 2)
    n = n0 + n1
    part = lambda k, q: np.where(k > 0, k * np.log(np.maximum(k, 1) / (n * q)), 0)
    gain = 2 * (part(n1, share) + part(n0, 1 - share))
    odds = np.log((n1 + 0.5) / (n0 + 0.5)) - np.log(share / (1 - share))
    found = np.where(gain > 12, np.clip(odds, -3, 3) / 2, 0)
    order = sorted(range(len(word)), key=lambda i: (-gain[i], -n[i], word[i]))[:most]
    return [word[i] for i in order], found[order]


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """label and text of at most per_class rows of each label, by lot: that of the label's doc_id first, so that few texts are fetched, then that of the row, in case
    an id has many rows."""
    lot = F.xxhash64("doc_id")
    some = lambda df, by: df.withColumn("_at", F.row_number().over(Window.partitionBy("label").orderBy(by))).filter(F.col("_at") <= per_class).drop("_at")
    # written, so that its size is known and Spark sends it to the documents, not these to it, while it is small
    drawn = cut(some(labels.filter("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("int")).distinct(), lot))
    rows = docs.select("doc_id", "text").join(drawn, "doc_id").withColumn("_lot", F.xxhash64("doc_id", "text"))
    return some(rows, F.col("_lot")).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, words: int = 8192, each: int = 2) -> Network:
    """Fit on docs(doc_id, text) and labels(doc_id, label of 0 or 1). Null labels and ids teach nothing. Without rows, or with one label only, every text gets the same score.

    Bounds: per_class rows of each label, their `words` most telling words that three texts have, and of each row `each` windows
    with the strongest words and one by lot, of LONGEST bytes at most."""
    rows = cut(sample(docs, labels, per_class))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            terms, before = tokens(*as_bytes(part.column(1)))
            width = max(1, len(terms.dictionary))
            pair = np.unique(row_of(before) * width + terms.indices.to_numpy(zero_copy_only=False))
            yield pa.record_batch([part.column(0).take(pa.array(pair // width)), terms.dictionary.cast(pa.string()).take(pa.array(pair % width))], names=["label", "word"])

    counts = rows.mapInArrow(distinct, "label int, word string").groupBy("word").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    apart = F.abs(F.log((F.col("n1") + 0.5) / (F.col("n0") + 0.5))) * F.sqrt(F.col("n0") + F.col("n1"))
    listed = counts.filter((F.col("n0") + F.col("n1") >= 3) & (F.octet_length("word") <= 64)).orderBy(F.desc(apart), "word").limit(2 * words).collect()
    vocabulary, strength = _evidence(sorted((r["word"], r["n0"], r["n1"]) for r in listed), words)
    told = dict(zip(vocabulary, strength.tolist()))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            terms, before = tokens(*as_bytes(part.column(1)))
            own = terms.dictionary.cast(pa.string()).to_pylist()
            code = terms.indices.to_numpy(zero_copy_only=False)
            value = np.array([told.get(w, 0.0) for w in own] + [0.0])[code] if len(code) else np.zeros(0)
            size = np.concatenate([[0], np.cumsum(np.array([len(w.encode()) for w in own], np.int64)[code])]) if len(code) else np.zeros(1, np.int64)
            start, n, row = windows(before)
            fits = size[start + n] - size[start] <= LONGEST
            best = np.array([value[a : a + k].max() if k else 0.0 for a, k in zip(start, n)])
            lot = mix((start - before[row]).astype(U) * U(0x9E3779B97F4A7C15) + n.astype(U)).astype(np.float64)
            by_value, by_lot = np.lexsort((start, -best, row)), np.lexsort((lot, row))
            place = np.arange(len(row)) - np.searchsorted(row, row)
            take = np.unique(np.concatenate([by_value[place < each], by_lot[place < 1]]))
            take = take[fits[take]]
            rank = np.zeros(len(row), np.int64)
            rank[by_value] = place
            # of a text marked 1 only the strongest window is sure to be
            take = take[(part.column(0).to_numpy(zero_copy_only=False)[row[take]] == 0) | (rank[take] == 0)]
            yield pa.record_batch([part.column(0).take(pa.array(row[take])), pa.array([[own[c] for c in code[a : a + k]] for a, k in zip(start[take], n[take])], pa.list_(pa.string()))], names=["label", "terms"])

    taught = sorted((r["label"], r["terms"]) for r in rows.mapInArrow(chosen, "label int, terms array<string>").collect())
    model = fit([t for _, t in taught], np.array([y for y, _ in taught], float), vocabulary, strength)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            logit, _, row = model.logits(part.column(1))
            yield pa.record_batch([part.column(0), pa.array(np.maximum.reduceat(logit, np.searchsorted(row, np.arange(part.num_rows))).astype(float))], names=["label", "logit"])

    tops = np.array(sorted((r["logit"], r["label"]) for r in rows.mapInArrow(highest, "label int, logit double").collect()))
    if len(tops):
        # labels are drawn evenly; the corpus has them in its own proportion
        shares = {r["label"]: r["n"] for r in labels.filter("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
        a, b = line_through(tops[:, 0], tops[:, 1])
        drawn = max(1, (tops[:, 1] == 1).sum()) / max(1, (tops[:, 1] == 0).sum())
        model.line = (a, b + float(np.log(max(1, shares.get(1, 0)) / max(1, shares.get(0, 0)) / drawn)))
    return model


def score(docs: DataFrame, model: Network) -> DataFrame:
    """docs(doc_id, text) to doc_id, score (0 to 1), windows and worst, the first term of the highest window. Repeated rows are scored alike, an empty table gives an empty
    result; other columns play no part. A text counts whole, in as many windows as it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            logit, at, row = model.logits(part.column(1))
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            top = np.maximum.reduceat(logit, first[:-1])
            hit = np.flatnonzero(logit == top[row])
            worst = at[hit[np.searchsorted(row[hit], np.arange(part.num_rows))]]
            yield pa.record_batch([part.column(0), pa.array(np.round(model.probability(top), 6)), pa.array(np.diff(first)), pa.array(worst)], names=["doc_id", "score", "windows", "worst"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, windows long, worst long")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learnt from the labels of those that aren't held out; a null id isn't."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").filter(~out)
    scored = score(docs, train(docs, labels.select("doc_id", F.col("toxic").alias("label"))))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "windows", "worst")
