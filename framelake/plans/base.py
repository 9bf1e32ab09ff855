"""The register of queries, and fragments of DuckDB's SQL that several of them share."""

from __future__ import annotations

from framelake.sources.adapters import FRAME, PACKETS_SQL

#: Expressions of the headers in DuckDB's SQL.
MODE = "CASE WHEN toc < 96 THEN 'silk' WHEN toc < 128 THEN 'hybrid' ELSE 'celt' END"
BANDWIDTH = """CASE WHEN toc // 8 < 4 THEN 'narrow' WHEN toc // 8 < 8 THEN 'medium' WHEN toc // 8 < 12 THEN 'wide' WHEN toc // 8 < 14 THEN 'superwide'
    WHEN toc // 8 < 16 THEN 'full' WHEN toc // 8 < 20 THEN 'narrow' WHEN toc // 8 < 24 THEN 'wide' WHEN toc // 8 < 28 THEN 'superwide' ELSE 'full' END"""
SIZE = """(CASE WHEN toc // 8 < 12 THEN (CASE toc // 8 % 4 WHEN 0 THEN 480 WHEN 1 THEN 960 WHEN 2 THEN 1920 ELSE 2880 END)
    WHEN toc // 8 < 16 THEN (CASE toc // 8 % 2 WHEN 0 THEN 480 ELSE 960 END) ELSE (CASE toc // 8 % 4 WHEN 0 THEN 120 WHEN 1 THEN 240 WHEN 2 THEN 480 ELSE 960 END) END)"""
FRAMES = "(CASE toc % 4 WHEN 0 THEN 1 WHEN 3 THEN second_byte % 64 ELSE 2 END)"
STRICT = f"(CASE WHEN {FRAMES} BETWEEN 1 AND 48 AND {FRAMES} * {SIZE} <= 5760 THEN {FRAMES} END)"
WITH = f"WITH packets AS ({PACKETS_SQL})"
SLOTS = f"""gaps AS (SELECT stream_id, seq, seq - lag(seq) OVER (PARTITION BY stream_id ORDER BY seq) - 1 AS missing FROM packets WHERE NOT lost),
    slots AS (SELECT stream_id, seq - ago AS seq, ago, (seq - ago) * {FRAME} AS ts48 FROM (SELECT stream_id, seq, unnest(range(1, missing + 1)) AS ago FROM gaps WHERE missing > 0 AND missing < 100))"""
LOST = f"{WITH}, {SLOTS}"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add
