"""The whole pipeline against a brute-force version of every stage."""

import re
from zlib import crc32

import duckdb
import numpy as np
from test_dedup import brute_classes
from test_tokens import library

import corpus_pipeline
from framelake.llm.queries import ORACLE_SQL
from framelake.llm.secrets import RULES


def removed(texts, length=200):
    """Texts without what strings of `length` bytes with another place cover, in whole characters."""
    count = {}
    for t in texts:
        b = t.encode()
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for t in texts:
        b = t.encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        at, kept = 0, []
        for ch in t:
            n = len(ch.encode())
            kept.append("" if all(mark[at : at + n]) else ch)
            at += n
        out.append("".join(kept))
    return out


def redacted(text):
    spans = []
    for _, pattern, group, least in RULES:
        spans += [m.span() for m in re.finditer(pattern, text, re.A) if len(m.group(group)) >= least]
    out, at = "", 0
    for a, b in sorted(spans):
        if a > at or not at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline_matches_brute_force(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    good = {d for d, ok in con.execute(f"select doc_id, kept from ({ORACLE_SQL['op8_quality_rules']})").fetchall() if ok}
    docs = [(d, t) for d, t in con.execute("select doc_id, text from documents order by doc_id").fetchall() if d in good]
    docs = [(d, t or "") for d, t, c in brute_classes(docs, True) if d == c]
    exact, want = library("byte_bpe_50k.json"), set()
    for (d, _), t in zip(docs, removed([t for _, t in docs])):
        ids = exact.encode(redacted(t), add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        for k, end in enumerate(range(first, len(ids) + 1, 2048)):
            start = max(0, end - 2048)
            want.add((d, k, start, end - start, crc32(np.array(ids[start:end], "<u4").tobytes())))
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048


def test_extra_columns_and_repeated_rows(spark, sf_dir):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "web", 5, 9), (1, words, "de", "web", 5, 9), (1, words + " more", "en", "web", 5, 9), (2, words, "en", None, 5, 9), (None, words, "en", "web", 5, 9), (None, "alone " + words[::-1], "en", "web", 5, 9), (None, "alone " + words[::-1], "en", "web", 5, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _ int, offset int").withColumnRenamed("source", "_row")
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.lang) for r in out.collect()) in ([("1", "de"), ("None", "en")], [("1", "en"), ("None", "en")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and 0 < got.count() <= docs.count()
