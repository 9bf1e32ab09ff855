"""Conversation repair against its SQL, against all edits tried out, and on odd tables."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from framelake.llm import turns
from framelake.llm.queries import ORACLE_SQL
from framelake.llm.turns import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int"


def brute(rows):
    """The cheapest audit of rows (role, text), by trying every edit with up to two inserts at every place."""
    seen, kinds = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        kinds.append("must go" if not body or (role, text) in seen else "short" if body[-1] not in ".!?" else "fine")
        seen.add((role, text))
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1) if len(rows) < 4 else [(0,) * (len(rows) + 1)]:
        for edits in itertools.product("KRD", repeat=len(rows)):
            if any(k == "must go" and e != "D" for k, e in zip(kinds, edits)):
                continue
            cost = 5 * sum(inserts) + sum({"K": 0, "R": 1, "D": 2}[e] + 5 * (k == "short" and e != "D") for k, e in zip(kinds, edits))
            audit = "".join("I" * n + e for n, e in zip(inserts, edits)) + "I" * inserts[-1]
            slots = [s for n, e, (role, _) in zip(inserts, edits, rows) for s in ["?"] * n + ([role[:1] or "-"] if e == "K" else ["?"] if e == "R" else [])] + ["?"] * inserts[-1]
            words = {"s" * lead + "ua" * n for n in range(6) for lead in range(2) if n or not lead}
            if (best is None or (cost, audit) < best) and any(len(w) == len(slots) and all(a == b or (a == "?" and b in "ua") for a, b in zip(slots, w)) for w in words):
                best = (cost, audit)
    return best


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def test_cheapest_edits(spark):
    r, convs = random.Random(5), {}
    for c in range(160):
        n = r.randint(1, 3) if c % 2 else r.randint(4, 7)
        convs[c] = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), r.choice(["One.", "Two!", "three", " \t", "", "Four?"])) for t in range(n)]
    rows = [x for rows in convs.values() for x in rows]
    _, plans = turns.repair(spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA).repartition(5))
    got = {p.conv_id: (p.cost, p.audit) for p in plans.collect()}
    assert got == {c: brute([(role, text) for _, _, role, text in by_turn(rows)]) for c, rows in convs.items()}


def test_long_conversation_in_parts(spark, monkeypatch):
    """The same plan however the rows are cut; what is written is the plan carried out."""
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), f"{r.randrange(900)}{r.choice('.!?,')}") for c, n in ((1, 700), (None, 5), (3, 40)) for t in range(n)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA)
    whole = {p.conv_id: (p.cost, p.audit, p.illegal) for p in turns.repair(df)[1].collect()}
    monkeypatch.setattr(turns, "SLICE", 16)
    stretches = turns.parts(turns.judged(df))
    assert stretches.count() > 40
    plans = turns.plans(stretches)
    assert {p.conv_id: (p.cost, p.audit, p.illegal) for p in plans.collect()} == whole
    out = sorted((x.place, x.role, x.text) for x in turns.repaired(df, plans).filter("conv_id = 1").collect())
    assert [x[0] for x in out] == list(range(len(out))) and re.fullmatch("(s?(ua)+)?", "".join(x[1][0] for x in out))
    sha = turns.digests(df, plans).filter("conv_id = 1").first().repaired_sha256
    assert sha == hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in out).encode()).hexdigest()
    roles = [x[2][0] for x in rows if x[0] == 1]
    assert whole[1][2] == sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


@pytest.mark.parametrize("odd", [True, False])
def test_query_and_sql(spark, sf_dir, tmp_path, odd):
    folder = sf_dir
    if odd:
        folder = str(tmp_path)
        rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "A."), (1, None, "user", "A."), (1, 7, "assistant", None), (2, 5, "system", "é日本"), (2, 5, "system", "é日本"), (2, 6, "Üser", "x" * 70_000 + "?"), (4, 2, "user", "")]
        rows += [(9, t, ["user", "assistant"][t % 2], f"Turn {t % 40}.") for t in range(120)] + [(c, 0, "user", "Hello.") for c in range(20, 60)]
        spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet{'/*.parquet' if odd else ''}'")
    ours, theirs = op11_conversation_repair(spark, folder).toPandas(), con.execute(ORACLE_SQL["op11_conversation_repair"]).df()
    rows = lambda t: sorted(tuple(map(str, r)) for r in t[sorted(ours.columns)].astype(object).where(t[sorted(ours.columns)].notna(), None).itertuples(index=False))
    strip = lambda rows: [tuple(x.removesuffix(".0") for x in r) for r in rows]
    assert strip(rows(ours)) == strip(rows(theirs)) and len(ours)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11_conversation_repair(spark, str(tmp_path)).count() == 0
