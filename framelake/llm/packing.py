"""Best-fit packing of documents into fixed-length token sequences.

Only the histogram of piece lengths (at most `capacity` rows, whatever the corpus) reaches the driver.
There a configuration linear program - patterns of lengths that fill a sequence, each length covered as
often as it occurs - is solved by multiplicative weights: a knapsack over the current prices finds the
dearest patterns, and the lengths that they cover get cheaper. The fractional solution is rounded, and what that leaves
over goes into a further program; best fit, run on classes of equal bins, places the last hundredth. Executors then give the r-th piece of
a length its sequence and offset by binary search in the table of patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framelake.llm._common import aside, cut, restored, slots
from framelake.llm._text import parts
from framelake.llm.chunks import ByteLevelEncoder

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def dearest(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity: the price of the dearest multiset of lengths (ascending) within it, and the index of one of them (-1: a token stays free)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(int(lengths[0]), capacity + 1):
        best[room] = best[room - 1]
        value = best[room - lengths[: upto[room]]] + prices[: upto[room]]
        i = int(value.argmax())
        if value[i] > best[room]:
            best[room], choice[room] = value[i], i
    return best, choice


def chosen(choice: np.ndarray, lengths: np.ndarray, room: int) -> dict[int, int]:
    """The multiset that dearest() chose for this room: {index: times}."""
    found: dict[int, int] = {}
    while room > 0:
        if (i := int(choice[room])) < 0:
            room -= 1
        else:
            found[i] = found.get(i, 0) + 1
            room -= int(lengths[i])
    return found


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest multiset of lengths (ascending) within the capacity: {index: times}."""
    return chosen(dearest(prices, lengths, capacity)[1], lengths, capacity)


class Prices:
    """Logarithms of the lengths' prices, at first the lengths themselves. bound: no packing has fewer sequences, as any prices prove
    it: demand times price over the dearest pattern. size: sequences of the last cover, scaled until it has every length in full."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.lengths = np.array(sorted(histogram), np.int64)
        self.log, self.bound, self.size = np.log(self.lengths.astype(float)), 0.0, float("inf")


def configuration_lp(histogram: dict[int, int], capacity: int, rounds: int = 100, rate: float = 0.2, state: Prices | None = None) -> list[tuple[dict[int, int], float]]:
    """A fractional cover of the histogram: [({length: times}, how many such sequences)], scaled for the median length to be covered.

    Multiplicative weights for covering: a length's price falls by exp(-rate * share of its demand that the chosen pattern covers in
    this step); the step is as long as the scarcest length of the pattern allows. In each round one knapsack serves all patterns that
    are within `rate` of the dearest by the prices as they fall. Afterwards `state` has the mean of the second half's prices, for a next
    call with more rounds at a lower rate, and what these prove."""
    state = state or Prices(histogram)
    lengths, log_price = state.lengths, state.log
    demand = np.array([histogram[int(x)] for x in lengths], float)
    covered, used, late = np.zeros(len(lengths)), {}, []

    def priced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prices = np.exp(log_price - log_price.max())
        best, choice = dearest(prices, lengths, capacity)
        state.bound = max(state.bound, float((demand * prices).sum() / best[capacity]))
        return prices, best, choice

    for step in range(rounds):
        prices, best, choice = priced()
        if 2 * step >= rounds - 1:
            late.append(log_price - log_price.max())
        least = (1 - rate) * best[capacity]
        with_each = prices + best[capacity - lengths]
        near = np.flatnonzero(with_each >= least)
        log_price = log_price.copy()
        for i in near[np.argsort(-with_each[near], kind="stable")].tolist():
            pattern = chosen(choice, lengths, capacity - int(lengths[i]))
            pattern[i] = pattern.get(i, 0) + 1
            if sum(t * prices[k] for k, t in pattern.items()) < least:
                continue
            times = min(demand[k] / t for k, t in pattern.items())
            key = tuple(sorted((int(lengths[k]), t) for k, t in pattern.items()))
            used[key] = used.get(key, 0.0) + times
            for k, t in pattern.items():
                covered[k] += t * times
                log_price[k] -= rate * t * times / demand[k]
                prices[k] *= np.exp(-rate * t * times / demand[k])
    state.log = log_price = np.mean(late, axis=0)
    priced()
    share = covered / demand
    state.size = sum(used.values()) / share.min() if share.min() else float("inf")
    reached = float(np.median(share)) or 1.0
    return [(dict(k), x / reached) for k, x in used.items()]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram. Bins with the same contents are one class with a count, so the
    work follows the number of distinct lengths, not of pieces: [({length: times}, sequences)]."""
    classes: dict[int, list[tuple[dict[int, int], int]]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in classes if r >= size):
            fit, kept = room // size, []
            for contents, n in classes.pop(room):
                full = min(n, left // fit) if left else 0
                if full:
                    classes.setdefault(room - fit * size, []).append(({**contents, size: fit}, full))
                    left, n = left - full * fit, n - full
                if n and 0 < left < fit:
                    classes.setdefault(room - left * size, []).append(({**contents, size: left}, 1))
                    left, n = 0, n - 1
                if n:
                    kept.append((contents, n))
            if kept:
                classes.setdefault(room, []).extend(kept)
            if not left:
                break
        fit = capacity // size
        if left // fit:
            classes.setdefault(capacity - fit * size, []).append(({size: fit}, left // fit))
        if left % fit:
            classes.setdefault(capacity - left % fit * size, []).append(({size: left % fit}, 1))
    return [x for group in classes.values() for x in group]


def rounded(patterns: list[tuple[dict[int, int], float]], histogram: dict[int, int], least: int = 0) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Whole sequences from the fractional ones, the most frequent patterns first, as far as pieces are left, and the pieces that they leave.
    A pattern that rounds to nothing is taken `least` times."""
    left, out = dict(histogram), []
    for pattern, x in sorted(patterns, key=lambda p: (-p[1], sorted(p[0].items()))):
        whole = min(max(least, round(x)), *(left[k] // t for k, t in pattern.items()))
        if whole:
            out.append((pattern, whole))
            for k, t in pattern.items():
                left[k] -= whole * t
    return out, {k: v for k, v in left.items() if v}


#: (rounds, rate) of a program, each from the prices of the one before; how many programs follow each other at most; and the share of sequences
#: that may stay with best fit before the last of them.
SCHEDULE, PROGRAMS, REMNANT = ((50, 0.02), (60, 0.2), (60, 0.07), (100, 0.02), (100, 0.007)), 12, 0.01


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], int, float]:
    """Whole sequences for every piece of the histogram [({length: times}, sequences)], how many of them are the
    programs', and a lower bound of any packing.

    A program's fractional solution is rounded, the pieces that this leaves are the demand of a program of their own, and so on; best fit places the
    last few. After each entry of the schedule the solution is rounded in two ways, with rare patterns and without; of these the one is kept that best fit
    would complete with the fewest sequences, and of equal ones that which leaves it the least. The plan ends where the sequences were fewest, so it
    never has more than best fit alone. A schedule ends early where the whole plan has
    no more sequences than the bound. A program has 370 rounds at most, and there are at most PROGRAMS of them, whatever the histogram."""
    histogram = {int(k): int(v) for k, v in histogram.items() if v}
    if not histogram:
        return [], 0, 0.0
    count = lambda x: sum(n for _, n in x)
    bound, least = 0.0, -(-sum(k * v for k, v in histogram.items()) // capacity)
    logs, out, left = dict[int, float](), [], histogram
    rest = best_fit(left, capacity)
    kept = out, rest
    for program in range(PROGRAMS):
        state, tried = Prices(left), []
        state.log = np.array([logs.get(k, x) for k, x in zip(state.lengths.tolist(), state.log)])
        for rounds, rate in SCHEDULE:
            patterns = configuration_lp(left, capacity, rounds, rate, state)
            for whole, remain in (rounded(patterns, left), rounded(patterns, left, 1)):
                fit = best_fit(remain, capacity)
                tried.append((count(whole) + count(fit), count(fit), len(tried), whole, remain, fit))
            if count(out) + min(tried)[0] <= max(least, np.ceil((bound or state.bound) - 1e-6)):
                break
        logs.update(zip(state.lengths.tolist(), state.log.tolist()))
        bound = bound or state.bound
        _, _, _, whole, left, rest = min(tried)
        if not whole:
            break
        out = out + whole
        if count(out) + count(rest) <= count(kept[0]) + count(kept[1]):
            kept = out, rest
        if count(rest) <= REMNANT * count(out):
            break
    return kept[0] + kept[1], count(kept[0]), max(bound, least)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Whole sequences for every piece of the histogram: [({length: times}, sequences)]."""
    return solve(histogram, capacity)[0]


def tokenize(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of documents(doc_id, text): doc_id, piece, start, length and ids (little-endian 32-bit).

    A null text is empty; every document ends with `end_id`. Only documents longer than the capacity are
    cut: the first piece is what full pieces leave over, all others are full. Rows with the same doc_id are separate documents; an empty table gives no
    piece, and other columns play no part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteLevelEncoder.shared(tokenizer)
        for part in parts(batches, "text"):
            ids, before = coder.encode(part.column(1))
            rows: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
            end = np.array([end_id], "<u4").tobytes()
            for doc_id, a, b in zip(part.column(0).to_pylist(), before, before[1:]):
                whole = ids[a:b].astype("<u4").tobytes() + end
                first = (len(whole) - 1) % (4 * capacity) + 1  # bytes of the first piece
                for k, end_at in enumerate(range(first, len(whole) + 1, 4 * capacity)):
                    at = max(0, end_at - 4 * capacity)
                    piece = whole[at:end_at]
                    for name, v in zip(rows, (doc_id, k, at // 4, len(piece) // 4, piece)):
                        rows[name].append(v)
            yield pa.record_batch(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int64()), pa.array(rows["ids"], pa.binary())],
                names=list(rows),
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces(length, ...); lengths lie between 1 and the capacity.

    pieces is computed once, and written. An empty table packs into nothing. Repeated rows are separate pieces. Sequences are filled
    without a gap from offset 0. Other columns pass through, but for those named like a result."""
    slim = cut(aside(pieces, "length").withColumn("_number", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in slim.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}  # of ranks of a length: start, first sequence, pieces a sequence, offset
    used, sequence = dict.fromkeys(histogram, 0), 0
    for pattern, n in plan(histogram, capacity):
        offset = 0
        for size, times in sorted(pattern.items(), reverse=True):
            ranges.setdefault(size, []).append((used[size], sequence, times, offset))
            used[size] += n * times
            offset += size * times
        sequence += n
    table = {k: np.array(v, np.int64).T.copy() for k, v in ranges.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            ids, offsets = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                start, first, times, offset = table[int(k)]
                r = np.searchsorted(start, rank[at], "right") - 1
                ahead = rank[at] - start[r]
                ids[at] = first[r] + ahead // times[r]
                offsets[at] = offset[r] + ahead % times[r] * k
            yield pa.record_batch([*batch.columns[:2], pa.array(ids), pa.array(offsets)], names=["length", "_row", "sequence_id", "offset"])

    ranked = slots(slim, "length", "_rank").select("length", "_row", "_rank")
    fields = StructType(ranked.schema.fields[:2]).add("sequence_id", "long").add("offset", "long")
    return restored(ranked.mapInArrow(place, fields), pieces.columns)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack whole documents: a row for each piece with its ids, sequence_id and offset."""
    return pack(tokenize(docs, tokenizer, capacity), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (bytes, in the order of offsets), doc_ids. A group has `capacity` pieces at most."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return packed.groupBy("sequence_id").agg(inside.alias("x")).select(
        "sequence_id", F.aggregate("x.length", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_tokens"),
        F.aggregate("x.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.col("x.doc_id").alias("doc_ids"),
    )


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; the digest stands for the ids, which the operator gives in full."""
    from framelake.llm._common import read

    pieces = tokenize(read(spark, sf_dir, "documents", "doc_id", "text"))
    packed = pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
