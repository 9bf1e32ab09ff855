"""Conversation structure repair: the cheapest edits after which the roles of a conversation follow a grammar.

Rows of a conversation are taken by turn (nulls first; ties by role, then by the digest of the text). Its roles, by their first letters, must
read (s?(ua)+)? in the end. Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or assistant turn) 5; blank rows and
rows that repeat an earlier one must go; a truncated row that stays costs 5 more. The audit is the edits' initials in order, and of
equally cheap ones the least in ASCII.

A batch of rows is worked off by a recursive query in DuckDB: each recursion advances one row in all conversations of the batch and keeps, for
each state of the grammar at the batch's start and each one now, the least cost and its audit. Batches are hash-partitioned by
conversation and slice of turns, so a long conversation is spread over tasks; the parts are then joined in order, state to state. No
two equally cheap audits of the same rows are such that one begins with the other (what is more would be inserts, which cost), so the
least audit of a part stays the least whatever follows.

Null roles and texts are one space, hence blank; null conversations are one of their own; an empty table gives an empty result; extra columns
play no part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._common import cut, read

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
SLICE, BATCH = 1024, 2048  # turns of a slice, rows that one query works off
SPACE = " \t\n\x0b\x0c\r"
ORDER = ("conv_id", "slice", "turn", "role", "digest")


def wanted(state: int) -> str:
    """The only role that an inserted or reroled row can have here."""
    return "assistant" if state == USER else "user"


def inserted() -> dict[tuple[int, int], int]:
    """How many inserts lead from one state to another, at least."""
    found = {(s, s): 0 for s in range(4)}
    for n in range(1, 4):
        for (a, b), m in list(found.items()):
            if m == n - 1:
                found.setdefault((a, AFTER[b, wanted(b)[0]]), n)
    return found


def moves() -> list[tuple[int, str, int, int, str]]:
    """The cheapest edits, inserts ahead included, for a row of each kind: state, kind, next state, cost, initials.

    A kind is `x` for a row that must go, else its role's first letter (`o` for any but s, u and a), a capital for a truncated row."""
    best: dict[tuple, tuple] = {}
    for (a, b), n in inserted().items():
        for kind in "xsuaoSUAO":
            low, more = kind.lower(), TRUNCATED if kind.isupper() else 0
            edits = [(b, DELETE, "D")]
            if kind != "x":
                edits.append((AFTER[b, wanted(b)[0]], REROLE + more, "R"))
                if (b, low) in AFTER:
                    edits.append((AFTER[b, low], KEEP + more, "K"))
            for to, cost, initial in edits:
                found = (n * INSERT + cost, "I" * n + initial)
                best[a, kind, to] = min(found, best.get((a, kind, to), found))
    return [(a, kind, to, *found) for (a, kind, to), found in best.items()]


def closings() -> dict[int, tuple[int, str]]:
    """What it costs to end from each state."""
    return {a: min((n * INSERT, "I" * n) for (x, b), n in inserted().items() if x == a and b in ENDS) for a in range(4)}


MOVES = ", ".join(f"({a}, '{kind}', {to}, {cost}, '{edits}')" for a, kind, to, cost, edits in moves())
WALK = f"""WITH RECURSIVE moves(state, kind, next, cost, edits) AS (VALUES {MOVES}),
    walk AS (
        SELECT part, origin, origin AS state, 0 AS i, 0 AS cost, '' AS audit FROM shapes, (SELECT unnest(range(4))::INT AS origin)
        UNION ALL
        SELECT part, origin, next, i + 1, best.cost, best.audit FROM (
            SELECT part, origin, m.next, i, min({{'cost': w.cost + m.cost, 'audit': w.audit || m.edits}}) AS best
            FROM walk w JOIN shapes USING (part) JOIN moves m ON m.state = w.state AND m.kind = shape[i + 1] WHERE i < len(shape) GROUP BY part, origin, m.next, i
        )
    )
    SELECT part, origin, state, cost, audit FROM walk JOIN shapes USING (part) WHERE i = len(shape) ORDER BY part, origin, state"""


def _shape(text: Column, role: Column, repeated: Column) -> Column:
    """The kind of a row, as in moves()."""
    told = F.rtrim(text, F.lit(SPACE))
    first = F.substring(role, 1, 1)
    kind = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return F.when((told == "") | repeated, "x").when(F.right(told, F.lit(1)).isin(".", "!", "?"), kind).otherwise(F.upper(kind))


def ordered(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with slice and digest, which place them in their conversation."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    at = F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 60))).cast("long")
    return rows.select("conv_id", at.alias("slice"), F.col("turn").cast("long"), role.alias("role"), F.md5(text).alias("digest"), text.alias("text"))


def judged(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with their count n, and what is wrong: conv_id, slice, turn, role, digest, n, fault (blank, truncated, or none), seen (an
    earlier turn has the same role and text) and shape, the kinds of all n.

    Equal rows are counted before they are shuffled, and the first of a text is found by its least turn, so neither a much repeated row nor a long
    conversation stands in one task."""
    told = F.rtrim("text", F.lit(SPACE))
    fault = F.when(told == "", "blank").when(~F.right(told, F.lit(1)).isin(".", "!", "?"), "truncated")
    light = ordered(rows).select(*ORDER, fault.alias("fault"), _shape(F.col("text"), F.col("role"), F.lit(False)).alias("kind"))
    counted = light.groupBy(*ORDER, "fault", "kind").agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = counted.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(place).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    seen = F.col("_first") != place
    n = F.col("n").cast("int")
    shape = F.when(seen, F.repeat(F.lit("x"), n)).otherwise(F.concat("kind", F.repeat(F.lit("x"), n - 1)))
    return counted.join(firsts, same).select(*ORDER, "n", "fault", seen.alias("seen"), shape.alias("shape"))


def faults(found: DataFrame) -> DataFrame:
    """By conversation: gaps between its turns, and how many rows have which fault first."""
    n = F.col("n")
    again = F.when(F.col("seen"), n).otherwise(n - 1)
    bad = lambda x, m, name: F.sum(F.when(x, m).otherwise(0)).alias(name)
    blank = F.coalesce(F.col("fault") == "blank", F.lit(False))
    turns = found.groupBy("conv_id", "turn").agg(bad(blank, n, "blank"), bad(~blank, again, "duplicate"), bad(F.col("fault") == "truncated", n - again, "truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


PARTS = "conv_id long, slice long, part long, first string, last string, illegal long, origins array<struct<origin: int, state: int, cost: long, audit: string>>"
LEGAL = {"su", "ua", "au"}


def parts(found: DataFrame) -> DataFrame:
    """Of each stretch of up to BATCH rows of a conversation: the least cost and audit from every state to every other, and what its roles begin with, end
    with and break inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1})
        number = 0
        open_: list[list] = []  # conv_id, slice, initials, shape

        def flush() -> pa.RecordBatch:
            nonlocal number
            con.register("shapes", pa.table({"part": pa.array(range(len(open_)), pa.int32()), "shape": pa.array(["".join(x[3]) for x in open_])}))
            best: list[list] = [[] for _ in open_]
            for part, origin, state, cost, audit in con.execute(WALK).fetchall():
                best[part].append({"origin": origin, "state": state, "cost": cost, "audit": audit})
            con.unregister("shapes")
            out = [(c, s, number + i, r[0], r[-1], sum(a + b not in LEGAL for a, b in zip(r, r[1:])), best[i]) for i, (c, s, r, _) in enumerate(open_)]
            number += len(out)
            open_.clear()
            return pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=schema)

        rows = 0
        for batch in batches:
            for conv, slice_, role, shape in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for at in range(0, len(shape), BATCH):
                    piece = shape[at : at + BATCH]
                    if rows + len(piece) > BATCH:
                        yield flush()
                        rows = 0
                    if not open_ or open_[-1][0] != conv or open_[-1][1] != slice_:
                        open_.append([conv, slice_, [], []])
                    open_[-1][2] += [role[:1]] * len(piece)
                    open_[-1][3].append(piece)
                    rows += len(piece)
        if open_:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PARTS))
    names = schema.names
    dealt = found.repartition("conv_id", "slice").sortWithinPartitions(*ORDER)
    return dealt.select("conv_id", "slice", "role", "shape").mapInArrow(run, PARTS)


PLANS = "conv_id long, illegal long, cost long, audit string"


def plans(stretches: DataFrame) -> DataFrame:
    """The parts of each conversation joined in order: conv_id, illegal (neighbours whose roles don't follow each other), cost and audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, last, illegal, out, begun = None, {}, None, 0, [], False

        def end() -> tuple:
            cost, audit = min((cost + CLOSINGS[s][0], audit + CLOSINGS[s][1]) for s, (cost, audit) in held.items())
            return conv, illegal, cost, audit

        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    if begun:
                        out.append(end())
                    conv, held, last, illegal, begun = row["conv_id"], {START: (0, "")}, None, 0, True
                illegal += row["illegal"] + (last is not None and last + row["first"] not in LEGAL)
                last, now = row["last"], {}
                for x in row["origins"]:
                    if x["origin"] in held:
                        cost, audit = held[x["origin"]]
                        found = (cost + x["cost"], audit + x["audit"])
                        now[x["state"]] = min(found, now.get(x["state"], found))
                held = now
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "illegal", "cost", "audit"), x)) for x in out], schema=schema)
            out = []
        if begun:
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "illegal", "cost", "audit"), end()))], schema=schema)

    CLOSINGS = closings()
    schema = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    return stretches.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "part").mapInArrow(run, PLANS)


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conv_id, audit, role, text), of which the first of a conversation has its audit alone, to (conv_id, place, edit, role, text) of what stays;
    a conversation begins with (conv_id, None, ...). Whatever a conversation's length, one row is held at a time."""
    conv, audit, at, state, place = None, "", 0, START, 0

    def inserts() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            role = wanted(state)
            yield conv, place, "I", role, ""
            state, at, place = AFTER[state, role[0]], at + 1, place + 1

    for c, plan, role, text in rows:
        if plan is not None:
            yield from inserts()
            conv, audit, at, state, place = c, plan, 0, START, 0
            yield conv, None, None, None, None
            continue
        yield from inserts()
        edit = audit[at]
        at += 1
        if edit != "D":
            role = role if edit == "K" else wanted(state)
            yield conv, place, edit, role, text
            state, place = AFTER[state, role[0]], place + 1
    yield from inserts()


def _along(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation behind its audit, in order within a partition: conv_id, audit, role, text."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = found.select("conv_id", F.lit(0).alias("kind"), none("long", "slice"), none("long", "turn"), none("string", "role"), none("string", "digest"), none("string", "text"), "audit")
    both = ordered(rows).select("conv_id", F.lit(1).alias("kind"), *ORDER[1:], "text", none("string", "audit")).unionByName(heads)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:]).select("conv_id", "audit", "role", "text")


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows(conv_id, turn, role, text) of conversations as their plans() leave them: conv_id, place (from 0), edit (K, R or I), role and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), *((n, pa.string()) for n in ("edit", "role", "text"))])
        held: list[tuple] = []
        for row in edited(_tuples(batches)):
            if row[1] is not None:
                held.append(row)
            if len(held) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)

    return _along(rows, found).mapInArrow(run, REPAIRED)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The SHA-256 of each repaired conversation, its rows as `role:text` with a newline between: conv_id, repaired_sha256.

    Such a hash takes its bytes in order, so a conversation's rows pass through one task, one row held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h, out, begun = None, hashlib.sha256(), [], False
        batch = lambda: pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
        for c, place, _, role, text in edited(_tuples(batches)):
            if place is None:
                if begun:
                    out.append((conv, h.hexdigest()))
                conv, h, begun = c, hashlib.sha256(), True
            else:
                h.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if len(out) == 1024:
                yield batch()
                out.clear()
        if begun:
            out.append((conv, h.hexdigest()))
            yield batch()

    return _along(rows, found).mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with every fault that the contract plants: by the checksum of conv_id and turn a row is dropped, emptied, cut short, repeated or given to the user."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    lot = F.crc32(named.cast("binary")) % 20
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), lot.alias("_lot")).filter("_lot != 0")
    text = F.when(F.col("_lot") == 1, "").when(F.col("_lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.explode(F.when(F.col("_lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select("conv_id", "turn", F.when(F.col("_lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), again.alias("_copy")).drop("_copy")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows(conv_id, turn, role, text): the faults() of each conversation, and its plans(), which repaired() and digests() carry out."""
    found = cut(judged(rows))
    return faults(found), cut(plans(parts(found)))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation, damaged as the contract says, with its faults, the cheapest repair and a digest of it."""
    given = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = damaged(given)
    wrong, found = repair(rows)
    out = given.select("conv_id").distinct()
    for side in (wrong, found, digests(rows, found)):
        side = side.withColumnRenamed("conv_id", "_c")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    empty = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
