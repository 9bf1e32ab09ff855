"""Suffix-array dedup: bytes covered by strings of a given length that occur more than once in the corpus.

Any such string holds an anchor: the position of the least of its hashed grams, chosen by content alone, so all copies of
the string hold the same anchor at the same place. Anchors - one in some 80 bytes - are shuffled by their gram; those whose
gram is unique are done. Where all contexts of a gram (the bytes that a string around it can reach) are equal by a 128-bit
cryptographic digest, the context is covered wholly. Where they differ, the suffixes that begin at the anchors, and the reversed
prefixes that end there, are sorted: prefix polynomial hashes and binary search give the common extension of two, so a comparison
takes logarithmic time in a mergesort over whole arrays, and neighbours are checked byte by byte against hash collisions.
The two orders then tell, for each place of a string around its anchor, whether another has it."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._common import aside, cut, read, restored
from framelake.llm._text import BASE, U, as_bytes, mix, parts, powers, prefix

GRAM = 40


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or largest of every `width` neighbours, in linear time: blocks of that width, run through both ways."""
    f, worst = (np.minimum, U(2**64 - 1)) if least else (np.maximum, U(0))
    n = len(x)
    full = -(-n // width) * width
    padded = np.concatenate([x, np.full(full - n, worst, U)]).reshape(-1, width)
    right = f.accumulate(padded, axis=1).reshape(-1)
    left = f.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(left[: n - width + 1], right[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position within the row, and gram hash of every anchor. A text shorter than `length` has none."""
    width = length - gram + 1  # grams in a string
    h = prefix(data)
    rows, at, keys = [], [], []
    for i in np.flatnonzero(np.diff(offsets) >= length).tolist():
        a, b = int(offsets[i]), int(offsets[i + 1])
        start = np.arange(a, b - gram + 1)
        g = mix((h[start + gram] - h[start]) * powers(b + 1)[1][start])
        least = sliding(g, width, True)  # of each string
        edge = np.zeros(width - 1, U)
        most = sliding(np.concatenate([edge, least, edge]), width, False)  # of the strings that hold a gram, the largest least
        chosen = np.flatnonzero(most == g)
        rows.append(np.full(len(chosen), i))
        at.append(chosen)
        keys.append(g[chosen])
    z = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(at), np.concatenate(keys)) if rows else (z, z, np.zeros(0, U))


def byte_rows(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """data[start : start + length] of each, as rows of `width` bytes that end in zeros."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[start].copy()
    out[np.arange(width)[None, :] >= length[:, None]] = 0
    return out


def suffix_sort(rows: np.ndarray, length: np.ndarray, group: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes rows[i, :length[i]] by (group, bytes), and each one's common length with the one before it in that
    order (0 where the group changes).

    A mergesort within each group: all pairs of runs of a level merge together, each suffix finding its place in the other run by
    binary search; two suffixes are compared by binary search over their prefix hashes. At the end neighbours are compared byte by byte. If
    hashes that collide have put any out of order, all are sorted by their bytes instead, so a collision costs time, never a result."""
    n, width = rows.shape
    h, flat = np.zeros((n, width + 1), U), rows.reshape(-1)
    steps = np.full(width, base % 2**64, U)
    steps[:1] = 1
    np.cumsum((rows.astype(U) + U(1)) * np.multiply.accumulate(steps, dtype=U)[None, :], axis=1, out=h[:, 1:])
    h = h.reshape(-1)

    def less(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before j of the same group; equal ones keep their order by number."""
        shared = np.minimum(length[i], length[j])
        low, high, a, b = np.zeros(len(i), np.int64), shared.copy(), i * (width + 1), j * (width + 1)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = h[a + middle] == h[b + middle]
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(low, middle - 1))
        at = np.minimum(low, width - 1)
        by_end = (length[i] < length[j]) | ((length[i] == length[j]) & (i < j))
        return np.where(low == shared, by_end, flat[i * width + at] < flat[j * width + at])

    order = np.argsort(group, kind="stable")
    ordered = group[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(first, n))
    start, end, run = np.repeat(first, size), np.repeat(first + size, size), 1
    while run < size.max(initial=0):
        at = np.arange(n)
        block = start + (at - start) // (2 * run) * (2 * run)
        live = np.flatnonzero(block + run < end)  # in blocks that have a second run
        at, block, stop = at[live], block[live], end[live]
        in_left = at - block < run
        low = np.where(in_left, block + run, block)  # the other run
        high = np.where(in_left, np.minimum(block + 2 * run, stop), block + run)
        other, ask = low.copy(), np.arange(len(at))
        while len(ask):
            middle = (low[ask] + high[ask]) >> 1
            before = less(order[middle], order[at[ask]])
            low[ask], high[ask] = np.where(before, middle + 1, low[ask]), np.where(before, high[ask], middle)
            ask = ask[low[ask] < high[ask]]
        merged = order.copy()
        merged[np.where(in_left, at, at - run) + (low - other)] = order[at]
        order, run = merged, 2 * run
    shared, right = _common(rows, length, group, order)
    if not right:
        order = np.array(sorted(range(n), key=lambda i: (group[i], rows[i, : length[i]].tobytes(), i)), np.int64)
        shared, _ = _common(rows, length, group, order)
    return order, shared


def _common(rows: np.ndarray, length: np.ndarray, group: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, bool]:
    """By their bytes: the common length of each suffix with the one before it in the order, and whether all stand right."""
    shared = np.zeros(len(order), np.int64)
    i, j = order[1:], order[:-1]
    a, b, most = rows[i], rows[j], np.minimum(length[i], length[j])
    differs = a != b
    e = np.minimum(np.where(differs.any(1), differs.argmax(1), rows.shape[1]), most)
    at = (np.arange(len(i)), np.minimum(e, rows.shape[1] - 1))
    inside = group[i] == group[j]
    right = np.where(inside, np.where(e == most, length[j] <= length[i], b[at] < a[at]), group[j] < group[i])
    shared[1:] = np.where(inside, e, 0)
    return shared, bool(right.all())


def repeated_around(contexts: list[bytes], left: np.ndarray, group: np.ndarray, length: int) -> list[tuple[int, int] | None]:
    """For distinct contexts, each with an anchor `left` bytes in: the run (relative to the anchor, end exclusive) covered by strings of
    `length` that hold the anchor's gram and that another context of the group has around its anchor, if there is any.

    The string that begins o bytes before the anchor is shared by those that agree in length - o bytes from the anchor on and in o
    before it: neighbours in both orders without a shorter common length between them."""
    n, reach = len(contexts), length - GRAM
    size = np.array([len(c) for c in contexts], np.int64)
    right, at = size - left, np.cumsum(size) - size + left
    data = np.frombuffer(b"".join(contexts), np.uint8)
    forward, with_next = suffix_sort(byte_rows(data, at, right, length), right, group)
    backward, with_last = suffix_sort(byte_rows(data[::-1], len(data) - at, left, reach), left, group)
    o = np.arange(min(int(left.max(initial=0)), reach) + 1)[:, None]
    new_f, new_b = (np.concatenate([[True], group[x[1:]] != group[x[:-1]]]) for x in (forward, backward))
    code, b_class, bits = np.empty((len(o), n), np.int64), np.empty((len(o), n), np.int64), n.bit_length()
    code[:, forward] = np.cumsum(new_f | (with_next < length - o), axis=1)
    b_class[:, backward] = np.cumsum(new_b | (with_last < o), axis=1)
    code = (code << bits | b_class) << bits | np.arange(n)
    np.copyto(code, (-1 - np.arange(n)) << bits, where=(left < o) | (right < length - o))  # it has no such string
    code.sort(axis=1)
    who, hit = code & ((1 << bits) - 1), np.zeros((len(o), n), bool)
    k, x = np.nonzero(code[:, 1:] >> bits == code[:, :-1] >> bits)
    hit[k, who[k, x]] = hit[k, who[k, x + 1]] = True
    first_o, last_o = hit.argmax(0), len(o) - 1 - hit[::-1].argmax(0)
    # all these strings hold the anchor's gram, so together they are one run
    return [(-b, length - a) if some else None for a, b, some in zip(first_o.tolist(), last_o.tolist(), hit.any(0).tolist())]


def digests(raw: bytes, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """128-bit cryptographic digests of raw[low:high], as two integers each: what is called equal without a look at its bytes is so by these."""
    found = b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), high.tolist()))
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def _content():
    """With doc_id it tells documents apart, even where an id is repeated."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def shrunk(docs: DataFrame) -> DataFrame:
    """(doc_id, content, text as zstd-compressed bytes): what is shuffled by document weighs a third of the texts."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            small = [None if t is None else zstandard.compress(t.encode(), 3) for t in part.column("text").to_pylist()]
            at = part.schema.get_field_index("text")
            yield part.set_column(at, "text", pa.array(small, pa.binary()))

    fields = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(shrink, fields)


def grown(column: pa.Array) -> list[bytes | None]:
    """The texts of a column of shrunk()."""
    return [None if x is None else zstandard.decompress(x) for x in column.to_pylist()]


CONTEXT = ["gram", "around", "check"]  # what tells a context: its gram, and the digest of the bytes within reach


def _counted(contexts: DataFrame, length: int, width: int = 20) -> DataFrame:
    """What repeated_around finds, for grams with more contexts than one task should hold, by counting digests; a gram's rows are
    spread over all tasks and added up before they are shuffled.

    The strings around an anchor are taken in blocks of `width` that begin side by side. All of a block share a core, and lie in a hull.
    Where a core is alone, none of its strings repeats; where all its hulls are equal, all do; only the others are counted one by one."""
    last = length - GRAM
    starts = np.arange(0, last + 1, width)  # bytes before the anchor, of each block's last string
    ends = np.minimum(starts + width - 1, last)  # and of its first

    def made(part: pa.RecordBatch, row: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
        ids = {name: part.column(name).take(pa.array(row)) for name in (*CONTEXT, "n")}
        return pa.record_batch({**ids, **{name: pa.array(np.ascontiguousarray(v)) for name, v in columns.items()}})

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "bytes", 1 << 20):
            data, offsets = as_bytes(part.column("bytes"))
            left, raw = part.column("left").to_numpy().astype(np.int64), data.tobytes()
            right = np.diff(offsets) - left
            row, k = np.nonzero((left[:, None] >= starts) & (right[:, None] >= length - ends))
            low, high = np.maximum(starts[k], length - right[row]), np.minimum(ends[k], left[row])  # the strings that the context holds
            row, k, low, high = (x[low <= high] for x in (row, k, low, high))
            at = offsets[row] + left[row]
            core, hull = digests(raw, at - starts[k], at + length - ends[k]), digests(raw, at - high, at + length - low)
            hull = hull ^ (low << 32 | high)[:, None]
            yield made(part, row, k=k.astype(np.int32), core=core[:, 0], core2=core[:, 1], hull=hull[:, 0], hull2=hull[:, 1], low=low.astype(np.int32), high=high.astype(np.int32))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "bytes", 1 << 17):
            data, offsets = as_bytes(part.column("bytes"))
            left, raw = part.column("left").to_numpy().astype(np.int64), data.tobytes()
            asked = np.zeros((part.num_rows, last + 1), bool)
            for i, ks in enumerate(part.column("ks").to_pylist()):
                for k in ks:
                    asked[i, starts[k] : ends[k] + 1] = True
            o = np.arange(last + 1)
            row, o = np.nonzero(asked & (left[:, None] >= o) & (np.diff(offsets)[:, None] - left[:, None] >= length - o))
            at = offsets[row] + left[row] - o
            code = digests(raw, at, at + length)
            yield made(part, row, o=o.astype(np.int32), code=code[:, 0], code2=code[:, 1])

    ids = "gram long, around long, check long, n long"
    contexts, core, string = cut(contexts.dropDuplicates(CONTEXT)), ["gram", "k", "core", "core2"], ["gram", "o", "code", "code2"]
    held = contexts.mapInArrow(cores, f"{ids}, k int, core long, core2 long, hull long, hull2 long, low int, high int")
    shared = held.groupBy(core).agg(F.sum("n").alias("m"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("hull", "hull2") for f in (F.min, F.max)]).filter("m > 1")
    shared = cut(shared.select(*core, F.expr("min_hull <> max_hull or min_hull2 <> max_hull2").alias("mixed")))
    held = cut(held.join(shared.hint("merge"), core).select(*CONTEXT, "k", "low", "high", "mixed"))
    asked = held.filter("mixed").groupBy(CONTEXT).agg(F.collect_list("k").alias("ks"))
    found = contexts.join(asked.hint("merge"), CONTEXT).select(*CONTEXT, "n", "left", "bytes", "ks")
    found = cut(found.mapInArrow(strings, f"{ids}, o int, code long, code2 long"))
    twice = cut(found.groupBy(string).agg(F.sum("n").alias("m")).filter("m > 1").drop("m"))
    single = found.join(twice.hint("merge"), string).select(*CONTEXT, F.col("o").alias("low"), F.col("o").alias("high"))
    runs = held.filter("not mixed").select(*CONTEXT, "low", "high").union(single).groupBy(CONTEXT).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return runs.select(*CONTEXT, (-F.col("high")).alias("a"), (length - F.col("low")).alias("b"))


def repeated_spans(docs: DataFrame, length: int = 200, most_contexts: int = 20_000) -> DataFrame:
    """documents(doc_id, text) to doc_id, content (hash of the text) and spans, the byte runs [a, b) that strings of `length` bytes
    cover which start at another place too; only rows that have any. Rows with the same doc_id and text share a row here. A gram with
    more than `most_contexts` different contexts is counted instead of sorted, with the same result."""
    reach = length - GRAM

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", 1 << 20):
            data, offsets = as_bytes(part.column(2))
            row, at, key = anchors(data, offsets, length)
            p = offsets[row] + at
            low, high = np.maximum(offsets[row], p - reach), np.minimum(offsets[row + 1], p + length)
            context = digests(data.tobytes(), low, high)
            around = context[:, 0] ^ (p - low)  # equal bytes with the anchor elsewhere are another context
            ids = [part.column(i).take(pa.array(row)) for i in range(2)]
            made = (pa.array(at, pa.int32()), pa.array(key.view(np.int64)), pa.array(around), pa.array(np.ascontiguousarray(context[:, 1])))
            yield pa.record_batch([*ids, *made], names=["doc_id", "content", "at", *CONTEXT])

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), _content().alias("content"), text.alias("text"))
    found = cut(docs.mapInArrow(find, "doc_id long, content long, at int, gram long, around long, check long"))
    both = [f(c).alias(f"{f.__name__}_{c}") for c in ("around", "check") for f in (F.min, F.max)]
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), *both).filter("n > 1")
    # a table of its own, so that the join isn't bound to the sums' partitions and a frequent gram's rows can be split
    grams = cut(grams.select("gram", F.expr("min_around <> max_around or min_check <> max_check").alias("mixed")))
    twice = cut(found.join(grams.hint("shuffle_hash"), "gram"))
    # of each context of a gram with several: how often it occurs, and one place to read it from (the three come from one row)
    place = [F.first(c).alias(c) for c in ("doc_id", "content", "at")]
    kinds = cut(twice.filter("mixed").groupBy(CONTEXT).agg(F.count("*").alias("n"), *place))
    frequent = cut(kinds.groupBy("gram").agg(F.count("*").alias("m")).filter(F.col("m") > most_contexts).select("gram"))
    crowded = not frequent.isEmpty()

    def quote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("around", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("left", pa.int32()), ("bytes", pa.binary()), ("crowded", pa.bool_())])
        for part in parts(batches, "text", 1 << 20):
            rows = []
            for wanted, raw in zip(part.column(0).to_pylist(), grown(part.column(1))):
                for x in wanted:
                    low = max(0, x["at"] - reach)
                    rows.append((x["gram"], x["around"], x["check"], x["n"], x["at"] - low, raw[low : x["at"] + length], x["crowded"]))
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), schema.types)], schema=schema)

    flag = F.coalesce("crowded", F.lit(False)) if crowded else F.lit(False)
    flagged = kinds.join(frequent.withColumn("crowded", F.lit(True)).hint("merge"), "gram", "left") if crowded else kinds
    wanted = flagged.groupBy("doc_id", "content").agg(F.collect_list(F.struct(*CONTEXT, "n", "at", flag.alias("crowded"))).alias("w"))
    contexts = shrunk(docs).join(wanted.hint("merge"), ["doc_id", "content"]).select("w", "text")
    contexts = cut(contexts.mapInArrow(quote, "gram long, around long, check long, n long, left int, bytes binary, crowded boolean"))  # once, for both ways

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole groups of grams stand together in a partition, in order; some thousand contexts at a time are compared."""
        held: list[pd.DataFrame] = []
        n = 0
        for frame in batches:
            held.append(frame)
            n += len(frame)
            if n >= 8192:
                frame = pd.concat(held, ignore_index=True)
                last = frame["gram"].iloc[-1]
                if (frame["gram"] != last).any():
                    yield decide(frame[frame["gram"] != last])
                held = [frame[frame["gram"] == last]]
                n = len(held[0])
        if held:
            yield decide(pd.concat(held, ignore_index=True))

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(CONTEXT)  # repeated rows of a document quote their contexts repeatedly
        runs = repeated_around(frame["bytes"].tolist(), frame["left"].to_numpy(np.int64), pd.factorize(frame["gram"])[0].astype(np.int64), length)
        for i, (n, left, raw) in enumerate(zip(frame["n"], frame["left"], frame["bytes"])):
            if n > 1:  # another place has this very context
                runs[i] = (-left, len(raw) - left) if len(raw) >= length else None
        some = [i for i, r in enumerate(runs) if r]
        a, b = zip(*(runs[i] for i in some)) if some else ((), ())
        return frame.iloc[some][CONTEXT].assign(a=np.array(a, np.int32), b=np.array(b, np.int32))

    decided = contexts.filter("not crowded").repartition("gram").sortWithinPartitions(*CONTEXT).mapInPandas(compare, "gram long, around long, check long, a int, b int")
    if crowded:
        decided = decided.unionByName(_counted(contexts.filter("crowded"), length))
    mixed = twice.filter("mixed").join(decided.hint("shuffle_hash"), CONTEXT)
    mixed = mixed.select("doc_id", "content", F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b")).alias("s"))
    whole = twice.filter("not mixed").select("doc_id", "content", F.struct(F.greatest(F.lit(0), F.col("at") - reach).alias("a"), (F.col("at") + length).alias("b")).alias("s"))
    return mixed.union(whole).groupBy("doc_id", "content").agg(F.array_sort(F.collect_list("s")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, most_contexts: int = 20_000) -> DataFrame:
    """documents(doc_id, text, ...) with kept (the bytes that remain), n_bytes, n_removed, n_spans and text, from which only
    characters that lose all their bytes are gone. A null text is empty here, and stays null in text. A text shorter than `length`, or
    without a repeat, stays as it is; an empty table gives an empty result. Other columns pass through, but for those named like a result."""
    spans, columns = cut(repeated_spans(docs, length, most_contexts)), docs.columns
    docs = aside(docs, "doc_id", "text")
    docs = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_content": _content()})
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "spans")
    names = [c for c in docs.columns if c not in ("_id", "_content")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    joined = shrunk(docs).join(spans.hint("merge"), ["_id", "_content"], "left").drop("_id", "_content")

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", 1 << 20):
            texts, kept, figures = [], [], []
            spans_ = part.column("spans").to_pylist() if part.column("spans").null_count < part.num_rows else [None] * part.num_rows
            for raw, s in zip(grown(part.column("text")), spans_):
                t, raw = raw, raw or b""
                merged: list[list[int]] = []
                for x in s or []:
                    a, b = x["a"], min(x["b"], len(raw))
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(e for m in merged for e in m), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else raw)
                figures.append((len(raw), sum(b - a for a, b in merged), len(merged)))
                for m in merged:  # shrink to whole characters
                    while m[0] < m[1] and raw[m[0]] & 0xC0 == 0x80:
                        m[0] += 1
                    while m[1] > m[0] and m[1] < len(raw) and raw[m[1]] & 0xC0 == 0x80:
                        m[1] -= 1
                edges = [0, *(e for m in merged for e in m), len(raw)]
                texts.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else t)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else part.column(c) for c in names]
            columns += [pa.array(kept, pa.binary()), *(pa.array([f[i] for f in figures], pa.int64()) for i in range(3))]
            yield pa.record_batch(columns, names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    cleared = joined.select(*names, "spans").mapInArrow(clear, f"{fields}, kept binary, n_bytes long, n_removed long, n_spans long")
    return restored(cleared, columns)


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document that strings of 200 bytes with another occurrence cover."""
    cleared = remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    return cleared.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
