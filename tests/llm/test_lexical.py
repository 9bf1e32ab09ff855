"""Ranked search against its SQL, and against all scores worked out in Python, on odd tables."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from framelake.llm import lexical
from framelake.llm.queries import ORACLE_SQL


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    docs = [(i, Counter(terms(text))) for i, text in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, df = sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, n in docs:
            m = 25 + 75 * n * len(docs) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return out


def got(spark, docs, items, k=10):
    queries = lexical.asked(items)
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(lexical.postings(docs, queries), queries, k).collect()]


key = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_terms():
    import numpy as np
    import pyarrow as pa

    texts = ["The cat, the HAT", "", None, "x", "é-É z9_Z", "...", "a", "\x7f日本\x00b"]
    found, before = lexical.tokens(*lexical.as_bytes(pa.array(texts)))
    words = [w.decode() for w in found.dictionary_decode().to_pylist()]
    assert [words[a:b] for a, b in zip(before, before[1:])] == [terms(t) for t in texts] and isinstance(before, np.ndarray)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_odd_documents(spark, odd, k):
    texts = [r.text for r in odd.collect()]
    r = random.Random(3)
    words = [w for t in texts for w in terms(t)[:200]]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate((1, 2, 5, 30, 200))] + [(7, ""), (8, None), (None, "Token apikey"), (9, "nowhere found"), (0, words[0] + " " + words[0]), (10, "é日本")]
    items.append(items[1])
    frame = spark.createDataFrame([(*x, "en", 3) for x in items], "item_id long, text string, term string, score int")
    expected = brute([(x.doc_id, x.text) for x in odd.collect()], [x for x in items if x[0] != 0], k)
    both = brute([(x.doc_id, x.text) for x in odd.collect()], [(0, items[0][1] + " " + items[-3][1])], k)
    assert key(got(spark, odd, frame, k)) == key(expected + both)
    assert got(spark, odd.limit(0), frame, k) == [] and got(spark, odd, frame.limit(0), k) == []


def test_copies_and_frequent_terms(spark):
    """Equal scores by thousands: the least ids win; a term of every document weighs nothing."""
    docs = [(i, "alpha beta gamma the") for i in range(3000)] + [(5000 + i, f"alpha the w{i % 50} the x{i}") for i in range(1000)]
    items = [(1, "alpha beta the"), (2, "w7 x7 the"), (3, "the"), (4, "x1 x2 x3 beta w1")]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    assert key(got(spark, frame(docs, "doc_id long, text string").repartition(7), frame(items, "item_id long, text string"))) == key(brute(docs, items, 10))


def test_query_and_sql(spark, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    theirs = con.execute(ORACLE_SQL["op13_ranked_search"]).fetchall()
    ours = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.op13_ranked_search(spark, sf_dir).collect()]
    assert key(ours) == key(theirs) and ours
