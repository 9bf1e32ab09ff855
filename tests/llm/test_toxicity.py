"""The recurrent network against slow versions of itself, its gradients against differences, its verdicts on texts held out, and odd tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framelake.llm import toxicity as T
from framelake.llm.lexical import tokens
from framelake.llm._text import as_bytes


def slow(model, text):
    """Logits of all windows of a text, one term after the other."""
    found, _ = tokens(*as_bytes(pa.array([text])))
    terms = [w.decode() for w in found.dictionary_decode().to_pylist()]
    p, h, out, at = model.p, T.HIDDEN, [], 0
    known = [w.decode() for w in model.words.to_pylist()]
    table = {t: model.gates(pa.array([t.encode()], pa.large_binary()))[0].astype(float) for t in set(terms)}
    for t in set(terms):
        data = b"\0" + t.encode() + b"\0"
        codes = [(T.mix(np.array([data[i] << 16 | data[i + 1] << 8 | data[i + 2]], np.uint64)) % np.uint64(T.GRAMS))[0] for i in range(len(data) - 2)]
        x = np.concatenate([p["word"][known.index(t) + 1 if t in known else 0], np.mean([p["gram"][int(c)] for c in codes], axis=0)])
        assert np.allclose(x @ p["input"] + p["bias"], table[t], atol=1e-5)
    sig = lambda x: 1 / (1 + np.exp(-x))
    while True:
        window, states = terms[at : at + T.WINDOW], [[], []]
        for way in range(2):
            s = np.zeros(h)
            for t in window if way == 0 else window[::-1]:
                g, inner = table[t][way * 3 * h : (way + 1) * 3 * h], s @ p["state"][way]
                r, z = sig(g[:h] + inner[:h]), sig(g[h : 2 * h] + inner[h : 2 * h])
                s = z * s + (1 - z) * np.tanh(g[2 * h :] + r * inner[2 * h :])
                states[way].append(s)
        u = np.array([np.concatenate(x) for x in zip(states[0], states[1][::-1])]).reshape(len(window), 2 * h)
        a = np.exp(u @ p["attention"])
        out.append(float((a / a.sum()) @ u @ p["out"] + p["level"][0]) if window else float(p["level"][0]))
        at += T.STRIDE
        if at >= len(terms) - (T.WINDOW - T.STRIDE):
            return out


def some_model(r):
    model = T.Network(pa.array([b"bad", b"good", "日本".encode()], pa.large_binary()), T.initial(3))
    for k in model.p:
        model.p[k] = r.normal(0, 0.7, model.p[k].shape)
    return model


def test_windows_and_states(spark):
    r = np.random.default_rng(3)
    model = some_model(r)
    texts = ["", None, "Bad", "bad good 日本 new " * 20, " ".join(f"w{i}" for i in range(48)), " ".join(f"w{i}" for i in range(49)), "...", "x" * 3000]
    logit, at, row = model.logits(pa.array(texts))
    for i, text in enumerate(texts):
        assert np.allclose(logit[row == i], slow(model, text), atol=2e-4) and at[row == i].tolist() == [k * T.STRIDE for k in range((row == i).sum())]
    out = T.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    for x in sorted(out, key=lambda x: x.doc_id):
        found = slow(model, texts[x.doc_id])
        assert x.windows == len(found) and abs(x.score - 1 / (1 + np.exp(-max(found)))) < 1e-3


def test_gradients():
    r = np.random.default_rng(4)
    p = T.initial(2)
    for k in p:
        p[k] = r.normal(0, 0.6, p[k].shape)
    gates, mask, slope = r.normal(0, 1, (3, 5, 6 * T.HIDDEN)), np.array([[1] * 5, [1] * 2 + [0] * 3, [0] * 5], float), r.normal(0, 1, 3)
    value = lambda: float(T.forward(p, gates, mask)[0] @ slope)
    by, d_gates = T.backward(p, T.forward(p, gates, mask, keep=True)[1], slope)
    for array, grad in [(p[k], by[k]) for k in by] + [(gates, d_gates)]:
        for _ in range(12):
            i = tuple(r.integers(0, n) for n in array.shape)
            kept = array[i]
            array[i] = kept + 1e-5
            more = value()
            array[i] = kept - 1e-5
            less = value()
            array[i] = kept
            assert abs((more - less) / 2e-5 - grad[i]) < 1e-6


def test_held_out(spark):
    """Texts that no label was learnt from."""
    folder = "/root/testdata/sf0.1"
    out = T.op12_toxicity(spark, folder)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    toxic = rows[rows.toxic == 1]
    assert (rows.predicted == rows.toxic).mean() > 0.97 and toxic.predicted.mean() > 0.85 and rows[rows.toxic == 0].predicted.mean() < 0.02


def test_odd_documents(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    labels = odd.select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") % 3 != 2, F.col("doc_id") % 3).cast("int").alias("toxic"), F.lit("x").alias("text"))
    labels.union(labels).write.parquet(f"{tmp_path}/labels.parquet")
    rows = T.op12_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (50, 51, 52)}) == 1
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert T.op12_toxicity(spark, f"{tmp_path}/none").count() == 0
    model = T.train(odd, labels.limit(0).select("doc_id", F.col("toxic").alias("label")))
    assert len({r.score for r in T.score(odd, model).collect()}) == 1


def test_one_id_with_many_rows(spark):
    """The sample is bounded by rows, not by ids."""
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).unionByName(spark.createDataFrame([(2, "other")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, label int")
    assert sorted((r.label, r["count"]) for r in T.sample(docs, labels, 100).groupBy("label").count().collect()) == [(0, 1), (1, 100)]
