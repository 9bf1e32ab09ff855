import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from framelake.llm.automaton import WordEncoder, encode
from framelake.llm.chunks import ByteLevelEncoder, ChunkTable, encode_chunks
from framelake.llm.packing import best_fit, configuration_lp, knapsack, op1_best_fit_packing, pack_documents, plan, sequences, solve
from framelake.llm.sharding import best_fit_decreasing, into_bins, op2_sharding, shard

ODD = [None, "", " ", "<|endoftext|>", "Hello<|endoftext|>World <|startoftext|><|endoftext|>  é x", "<|endoftext| >", "  a  b\n\nc\t d ", "İstanbul ß ﬁ é é", "日本語　テキスト", "\U0001f600x  y z", "<|endoftext|> it's 12345 don't!!", "</w> <unk>", "aaaa" * 3000, "ÀÉ " * 50, "\x85\x1c\x00"]


def library(path):
    found = Tokenizer.from_file(public_tokenizers.path(path))
    found.no_truncation()
    found.no_padding()
    return found


def test_both_encoders_equal_the_library(documents):
    texts = ODD + [r.text for r in documents.collect()]
    for coder, exact in ((ByteLevelEncoder.shared(), library("byte_bpe_50k.json")), (WordEncoder.shared(), library("word_bpe_49k.json"))):
        for part in (texts, texts[::-1]):  # the second time from the table of chunks
            ids, before = coder.encode(pa.array(part, pa.string()))
            for i, t in enumerate(part):
                assert ids[before[i] : before[i + 1]].tolist() == exact.encode(t or "", add_special_tokens=False).ids, t


def test_equal_hashes_are_told_apart():
    """Thue-Morse words and their complements collide under any polynomial hash modulo 2^64; and a table whose hashes all collide."""
    words = []
    for n in (10, 12):
        word = "a"
        for _ in range(n):
            word += word.translate(str.maketrans("ab", "ba"))
        words += [word, word.translate(str.maketrans("ab", "ba"))]
    texts = [*words, " ".join(words), *words[::-1]]
    for coder, exact in ((ByteLevelEncoder.shared(), library("byte_bpe_50k.json")), (WordEncoder.shared(), library("word_bpe_49k.json"))):
        for part in (texts, texts[::-1], [words[1]], [words[0]]):
            ids, before = coder.encode(pa.array(part))
            for i, t in enumerate(part):
                assert ids[before[i] : before[i + 1]].tolist() == exact.encode(t, add_special_tokens=False).ids
    data = np.frombuffer(b"onetwoonethreetwo", np.uint8)
    start, end = np.array([0, 3, 6, 9, 14]), np.array([3, 6, 9, 14, 17])
    fill = lambda a, b: (np.arange(len(a)), np.ones(len(a), int), np.array([{3: {111: 1, 116: 2}, 5: {116: 3}}[int(y - x)][int(data[x])] for x, y in zip(a, b)]))
    table = ChunkTable()
    for _ in range(2):
        ids, _ = encode_chunks(table, data, start, end, np.array([0, 5]), fill, np.zeros(5, np.uint64))
        assert ids.tolist() == [1, 2, 1, 3, 2]


def test_decoding_equals_the_library(odd):
    exact = library("word_bpe_49k.json")
    for r in encode(odd).collect():
        assert r.decoded == exact.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False)
    assert encode(odd).count() == odd.count() and encode(odd.limit(0)).count() == 0


def check_packed(rows, texts, capacity):
    exact = library("byte_bpe_50k.json")
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts.items():
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert len(mine) == max(1, -(-len(ids) // capacity)) and all(r.length == capacity for r in mine[1:])
        for r in mine:
            assert crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == (r.ids_crc32 if "ids_crc32" in r else crc32(r.ids))
    return len(places)


def test_packing(spark, sf_dir, documents, odd):
    rows = op1_best_fit_packing(spark, sf_dir).collect()
    used = check_packed(rows, {r.doc_id: r.text for r in documents.collect()}, 2048)
    assert used <= 1.01 * sum(r.length for r in rows) / 2048 + 1
    once = odd.filter("doc_id is not null and doc_id <> 3")
    packed = pack_documents(once, capacity=256)
    check_packed(packed.collect(), {r.doc_id: r.text for r in once.collect()}, 256)
    assert all(len(r.ids) == 4 * r.n_tokens for r in sequences(packed).collect())
    assert pack_documents(odd.limit(0)).count() == 0 and pack_documents(odd).count() > odd.count()


def test_plans():
    r = np.random.default_rng(0)
    histogram = {int(k): int(v) for k, v in zip(range(600, 1100, 7), r.integers(1, 3000, 72))}
    got, alone = plan(histogram, 2048), best_fit(histogram, 2048)
    placed = defaultdict(int)
    for pattern, n in got:
        assert sum(k * t for k, t in pattern.items()) <= 2048
        for k, t in pattern.items():
            placed[k] += n * t
    assert dict(placed) == histogram
    assert sum(n for _, n in got) <= sum(n for _, n in alone)
    assert all(sum(k * t for k, t in p.items()) <= 2048 for p, _ in configuration_lp(histogram, 2048, 20))
    assert knapsack(np.array([3.0, 5.0]), np.array([2, 3]), 7) == {1: 1, 0: 2}


def test_program_runs_until_it_is_near_its_bound():
    histogram = {k: 200 for k in range(550, 1000, 3)}
    got, programs, bound = solve(histogram, 2048)
    used = sum(n for _, n in got)
    assert used <= 1.02 * np.ceil(bound) and programs >= 0.9 * used
    assert sum(n for _, n in plan(histogram, 2048)) == used <= 0.95 * sum(n for _, n in best_fit(histogram, 2048))
    placed = defaultdict(int)
    for pattern, n in got:
        assert sum(k * t for k, t in pattern.items()) <= 2048
        for k, t in pattern.items():
            placed[k] += n * t
    assert dict(placed) == histogram
    easy = {k: 4000 // k + 1 for k in range(1, 900, 3)}  # best fit alone has as few as the tokens need; the program's plan has no more
    got, programs, bound = solve(easy, 2048)
    assert sum(n for _, n in got) == sum(n for _, n in best_fit(easy, 2048)) == bound and programs > 0
    assert solve({}, 2048) == ([], 0, 0.0) and sum(n for _, n in solve({2048: 3}, 2048)[0]) == 3


@pytest.mark.parametrize("lengths, most", [(range(1, 2049), 2999), (range(600, 1100), 1000), (range(1, 2049, 37), 1)])
def test_programs_place_nine_tenths(lengths, most):
    """All lengths that there are, large ones, and a few single pieces: best fit has no fewer sequences, and places next to none."""
    r = random.Random(1)
    histogram = {k: r.randint(1, most) for k in lengths}
    got, programs, bound = solve(histogram, 2048)
    used, placed = sum(n for _, n in got), defaultdict(int)
    for pattern, n in got:
        assert sum(k * t for k, t in pattern.items()) <= 2048
        for k, t in pattern.items():
            placed[k] += n * t
    assert dict(placed) == histogram and bound <= used
    assert used <= sum(n for _, n in best_fit(histogram, 2048)) and programs >= 0.9 * used


def test_best_fit_takes_the_tightest_bin():
    r = np.random.default_rng(1)
    sizes = sorted(r.integers(1, 60, 400).tolist(), reverse=True)
    room, want = [], []
    for s in sizes:
        fits = [(x, i) for i, x in enumerate(room) if x >= s]
        i = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(100)
        room[i] -= s
        want.append(i)
    assert best_fit_decreasing(sizes, 100) == want
    assert best_fit_decreasing([101], 100) is None
    sums = np.bincount(into_bins(sizes, 7), weights=sizes)
    assert sums.max() - sums.min() <= 4


def test_sharding(spark, sf_dir, documents, odd):
    rows = op2_sharding(spark, sf_dir).collect()
    assert len(rows) == documents.count()
    sums, shard_of = np.zeros(8), defaultdict(set)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, crc32(data))
        sums[r.shard] += r.size
        shard_of[texts[r.doc_id] or ""].add(r.shard)
    assert all(len(x) == 1 for x in shard_of.values()) and sums.max() <= 1.001 * sums.mean() + 100
    got = shard(odd, 4)
    assert got.count() == odd.count() and {"source", "kept", "spans"} <= set(got.columns) and dict(got.dtypes)["size"] == "bigint"
    for k in range(4):
        found = sorted(r.slot for r in got.filter(f"shard = {k}").collect())
        assert found == list(range(len(found)))
    assert shard(odd.limit(0), 4).count() == 0
