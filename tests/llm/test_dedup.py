import random
import re
from collections import Counter

import numpy as np

from framelake.llm.components import components
from framelake.llm.near_duplicates import classes, dart_minhash, op6_minhash_near_dedup
from framelake.llm.repeated_text import byte_rows, op7_suffix_array_dedup, remove_repeats, suffix_sort


def brute_removed(texts, length):
    count = Counter()
    for t in texts:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(mark)) if mark[i] and (not i or not mark[i - 1]))
        out.append((len(b), sum(mark), spans, bytes(x for x, m in zip(b, mark) if not m)))
    return out


def check_removed(docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((str(d), *b) for (d, _), b in zip(rows, brute_removed([t for _, t in rows], 200)))
    got = remove_repeats(docs, **options).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert any(w[2] for w in want)
    return got


def test_removal_matches_brute_force(odd, documents):
    small = odd.filter("doc_id is null or doc_id <> 53")
    check_removed(small)
    got = check_removed(small, most_contexts=2)
    assert set(got[0].asDict()) >= {"lang", "source", "size", "spans"}
    check_removed(documents.select("doc_id", "text"))


def test_removal_of_periodic_and_adversarial_texts(spark):
    r = random.Random(2)
    pool = ["".join(r.choice("ab é") for _ in range(r.randint(150, 500))) for _ in range(6)]
    rows = [(i, "".join(r.choice(pool)[r.randint(0, 60) :] if r.random() < 0.5 else "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 300))) for _ in range(r.randint(0, 4)))) for i in range(60)]
    rows += [(100, "x" * 1500), (101, "ab" * 400), (102, "w" * 201), (103, "y" * 200), (104, "z" * 201)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_removed(docs)
    check_removed(docs, most_contexts=3)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_suffixes_are_sorted():
    r = np.random.default_rng(0)
    data = r.integers(0, 2, 400).astype(np.uint8)
    start = r.permutation(300)
    length = np.minimum(r.integers(0, 101, 300), 400 - start)
    group = r.integers(0, 3, 300)
    rows = byte_rows(data, start, length, 100)
    at = lambda i: (group[i], data[start[i] : start[i] + length[i]].tobytes())
    for options in ({}, {"base": 0}):  # with base 0 all hashes of a length collide
        order, shared = suffix_sort(rows, length, group, **options)
        listed = [at(i) for i in order]
        assert listed == sorted(at(i) for i in range(300))
        for k in range(1, 300):
            (g, a), (h, b) = listed[k], listed[k - 1]
            same = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == (same if g == h else 0)
    assert not len(suffix_sort(rows[:0], length[:0], group[:0])[0])


def test_removal_outlasts_hash_collisions(spark):
    """Thue-Morse words and their complements collide under any polynomial hash modulo 2^64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word[:1024] + "x" + other[:1024]), (4, other[1000:1700]), (5, "q" + word[:256] + other[:256])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_removed(docs)
    check_removed(docs, most_contexts=1)


def shingle_counts(text, weighted):
    w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
    found = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    return found if weighted else Counter(dict.fromkeys(found, 1))


def brute_classes(rows, weighted):
    """A class id for each row; rows without an id are documents of their own."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = [(d, t or "", shingle_counts(t, weighted)) for d, t in rows]
    for i, (d, t, s) in enumerate(listed):
        for j, (e, u, v) in enumerate(listed[:i]):
            if t == u or (d is not None and d == e) or (s and v and (s & v).total() >= 0.8 * (s | v).total() - 1e-9):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _, _) in enumerate(listed):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, t, least.get(find(i))) for i, (d, t) in enumerate(rows)]


def test_classes_match_brute_force(spark, odd, documents):
    repeated = " ".join(f"w{i} {'same words again and again here' if i % 3 else ''}" for i in range(60))
    more = spark.createDataFrame([(900, repeated), (901, repeated.replace("w7 ", "x7 ")), (902, repeated + " same words again and again here" * 90), (None, "no id has this text at all"), (None, "no id has this text at all")], "doc_id long, text string")
    small = odd.select("doc_id", "text").union(more)
    for docs, options in ((small, {}), (small, {"weighted": False}), (small, {"block": 4}), (documents, {}), (documents, {"weighted": False})):
        want = brute_classes([(r.doc_id, r.text) for r in docs.collect()], options.get("weighted", True))
        got = classes(docs, **options).collect()
        assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == {d: c for d, _, c in want if d is not None}
        nulls = lambda rows: sorted(-1 if c is None else c for d, c in rows if d is None)
        assert nulls([(r.doc_id, r.class_id) for r in got]) == nulls([(d, c) for d, _, c in want])
        assert len(got) == len({d for d, _, _ in want if d is not None}) + sum(d is None for d, _, _ in want)
    assert classes(odd.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(3)
    e = r.integers(0, 2**63, 60).astype(np.uint64)
    w = r.random(60) * 4 + 0.1
    v = w * r.choice([0.5, 1.0, 2.0], 60)
    sig = dart_minhash(np.concatenate([e, e]), np.concatenate([w, v]), np.array([0, 60, 120]), 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04
    a, b = e[:50], e[10:]
    sig = dart_minhash(np.concatenate([a, b]), None, np.array([0, 50, 100]), 4096)
    assert abs((sig[0] == sig[1]).mean() - 40 / 60) < 0.04


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_queries(spark, sf_dir, documents):
    n = documents.count()
    assert op6_minhash_near_dedup(spark, sf_dir).count() == n and op7_suffix_array_dedup(spark, sf_dir).count() == n
