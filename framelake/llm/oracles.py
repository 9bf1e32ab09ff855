"""DuckDB SQL for the queries that SQL can express: op8, op10, op11 and op13. It states the rules anew, by other means where there are any."""

from __future__ import annotations

from framelake.llm import quality_rules as Q
from framelake.llm import turns as T
from framelake.llm.secrets import BASE, RULES

SPACE = r"[\x20\x09-\x0D]"
#: RE2 looks neither back nor ahead: what must not stand before a token is matched as group 1 instead.
WITHOUT_LOOKING_BACK = {"jwt": r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lengths(text: str) -> str:
    return f"list_transform({text}, lambda x: len(x))"


def op10() -> str:
    """Gaps and matches of each rule, added up to places."""
    found = []
    for i, (kind, pattern, group, least) in enumerate(RULES):
        moved = kind in WITHOUT_LOOKING_BACK
        p = _quoted(WITHOUT_LOOKING_BACK.get(kind, pattern))
        every = lambda g, p=p: _lengths(f"regexp_extract_all(text, {p}, {g})")
        lead = every(1) if moved else f"list_transform({every(0)}, lambda x: 0)"
        found.append(f"""SELECT r, {i} AS rule, '{kind}' AS kind, {least} AS least, {_lengths(f"string_split_regex(text, {p})")} AS gap, {every(2 if moved else 0)} AS whole, {every(2 if moved else group)} AS value, {lead} AS lead FROM d WHERE regexp_matches(text, {p})""")
    base = ", ".join(map(_quoted, BASE))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    listed = "kind || ':' || a || ':' || b, ',' ORDER BY a, rule"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), m AS ({" UNION ALL ".join(found)}), k AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m),
    s AS (SELECT r, rule, kind, (list_sum(gap[:i]) + list_sum(lead[:i]) + coalesce(list_sum(whole[:i - 1]), 0))::BIGINT AS a, whole[i] AS n FROM k WHERE value[i] >= least), t AS (SELECT *, (a + n)::BIGINT AS b FROM s)
    SELECT doc_id, {counts}, sha256(coalesce(string_agg({listed}) FILTER (WHERE kind IN ({base})), '')) AS base_sha256, coalesce(string_agg({listed}), '') AS spans FROM d LEFT JOIN t USING (r) GROUP BY r, doc_id"""


def op8() -> str:
    """Measures by words and windows as rows; histograms as lists; one reference for each language and one for all."""
    listed = ", ".join(_quoted(x) for x in Q.COMMON_WORDS)
    common = "CASE lang " + " ".join(f"""WHEN '{lang}' THEN [{", ".join(f"coalesce(how_often[{_quoted(c)}], 0)::BIGINT" for c in words)}]""" for lang, words in Q.COMMON_WORDS.items()) + " END"
    less = lambda text, pattern: f"len({text}) - len(regexp_replace({text}, {_quoted(pattern)}, '', 'g'))"
    total = lambda column, n: "[" + ", ".join(f"sum({column}[{i + 1}])::DOUBLE" for i in range(n)) + "]"
    width, classes = len(next(iter(Q.COMMON_WORDS.values()))) + 1, len(Q.CLASSES)
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END"

    def distance(p: str, q: str) -> str:
        a, b = f"({p}[i] / list_sum({p})::DOUBLE)", f"({q}[i] / list_sum({q})::DOUBLE)"
        terms = f"({part.format(x=a, a=a, b=b)} + {part.format(x=b, a=a, b=b)}) / 2"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN round(sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {terms})))), 6) END"

    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, regexp_replace(text, '{SPACE}+', '', 'g') AS dense, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    five AS (SELECT r, unnest(list_transform(range(1, len(words) - 3), lambda i: {{'i': i, 'w': concat_ws(' ', words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])}})) AS f FROM w),
    win AS (SELECT r, f.i AS i, count(*) OVER (PARTITION BY r, f.w) AS n FROM five),
    cov AS (SELECT r, count(DISTINCT at_) AS n_repeat FROM (SELECT r, unnest(range(i, i + 5)) AS at_ FROM win WHERE n > 1) GROUP BY r),
    h AS (SELECT *, len(words) AS n, list_histogram(words) AS how_often, regexp_replace(dense, '\p{{L}}+', '', 'g') AS signs FROM w),
    c AS (SELECT *, {less("dense", r"\p{Lu}+")} AS u, {less("signs", "[0-9]+")} AS dg, {less("signs", r"""[.,;:!?'"()-]+""")} AS p, {less("signs", "[#*$%&|<>]+")} AS y, {common} AS hits FROM h),
    x AS (SELECT r, doc_id, lang, n, coalesce(list_sum({_lengths("words")}), 0) AS word_chars, y, len(lines) - len(list_distinct(lines)) AS dups,
    [len(dense) - len(signs) - u, u, dg, len(text) - len(dense), p, y, len(signs) - dg - p - y] AS chars, list_append(hits, n - list_sum(hits)) AS common FROM c),
    ref AS (SELECT lang, count(*) AS docs, {total("chars", classes)} AS ref_chars, {total("common", width)} AS ref_common FROM x WHERE lang IS NOT NULL GROUP BY lang),
    own AS (SELECT lang, ref_chars, CASE WHEN lang IN ({listed}) THEN ref_common END AS ref_common FROM ref WHERE lang IN ({listed}) OR docs >= {Q.REFERENCE_DOCUMENTS}), whole AS (SELECT {total("chars", classes)} AS all_chars FROM x),
    j AS (SELECT x.*, coalesce(n_repeat, 0) AS rep, coalesce(ref_chars, all_chars) AS rc, ref_common AS rw FROM x LEFT JOIN cov USING (r) LEFT JOIN own USING (lang) CROSS JOIN whole),
    v AS (SELECT *, n < {Q.MIN_WORDS} OR 100 * rep > {Q.MAX_REPEATED_PERCENT} * n AS base_failed, CASE WHEN n >= {Q.CHARACTER_GUARD} THEN {distance("chars", "rc")} END AS char_distance, CASE WHEN n >= {Q.WORD_GUARD} THEN {distance("common", "rw")} END AS word_distance FROM j)
    SELECT doc_id, n::BIGINT AS n_words, word_chars::BIGINT AS word_chars, y::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND coalesce(char_distance, 0) <= {Q.CHARACTER_LIMIT} AND coalesce(word_distance, 0) <= {Q.WORD_LIMIT} AS kept, char_distance, word_distance FROM v"""


def op11() -> str:
    """A checksum worked out byte by byte; one walk over whole conversations, state by state, and one along the audit, which writes the text."""
    bits = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    named = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({named}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, bits[(xor(c, b) & 255) + 1])))"
    ends = ", ".join(f"({a}, {cost}, '{edits}')" for a, (cost, edits) in T.closings().items())
    role = "CASE WHEN w.state = 2 THEN 'assistant' ELSE 'user' END"
    last = "right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)"
    return f"""WITH RECURSIVE tab AS (SELECT {bits} AS bits), given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS lot FROM conversations, tab),
    hurt AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy FROM given WHERE lot <> 0),
    placed AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, {last} AS final FROM hurt),
    seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, lag(role) OVER (PARTITION BY c ORDER BY i) AS prior FROM placed),
    bad AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial FROM seen),
    kinds AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END AS kind FROM bad),
    told AS (SELECT c, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND left(prior, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM kinds GROUP BY c),
    moves(state, kind, next, cost, edits) AS (VALUES {T.MOVES}), ends(state, cost, edits) AS (VALUES {ends}),
    walk AS (SELECT c, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit FROM told UNION ALL
        SELECT c, i, next, best.cost, best.audit FROM (SELECT w.c, k.i, m.next, min({{'cost': w.cost + m.cost, 'audit': w.audit || m.edits}}) AS best FROM walk w JOIN kinds k ON k.c = w.c AND k.i = w.i + 1 JOIN moves m ON m.state = w.state AND m.kind = k.kind GROUP BY w.c, k.i, m.next)),
    done AS (SELECT c, min({{'cost': w.cost + e.cost, 'audit': w.audit || e.edits}}) AS best FROM walk w JOIN told t USING (c) JOIN ends e USING (state) WHERE w.i = t.n GROUP BY c),
    steps AS (SELECT c, best.audit AS audit, 0 AS at_, 0::BIGINT AS i, 0 AS state, '' AS said FROM done UNION ALL
        SELECT c, audit, at_, i, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE state END, CASE WHEN role IS NULL THEN said WHEN said = '' THEN role || ':' || text ELSE said || chr(10) || role || ':' || text END FROM (
            SELECT w.c, audit, at_ + 1 AS at_, w.i + CASE WHEN audit[at_ + 1] = 'I' THEN 0 ELSE 1 END AS i, state, said, CASE audit[at_ + 1] WHEN 'D' THEN NULL WHEN 'K' THEN k.role ELSE {role} END AS role, CASE WHEN audit[at_ + 1] = 'I' THEN '' ELSE k.text END AS text
            FROM steps w LEFT JOIN kinds k ON k.c = w.c AND k.i = w.i + 1 WHERE at_ < len(audit))),
    texts AS (SELECT c, sha256(said) AS sha FROM steps WHERE at_ = len(audit))
    SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
        coalesce(best.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN told t ON g.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN done USING (c) LEFT JOIN texts USING (c)"""


def op13() -> str:
    """Every document against every item, term by term."""
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS words FROM documents WHERE text IS NOT NULL), t AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS total FROM d WHERE len(words) > 0),
    p AS (SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d) GROUP BY r, doc_id, term),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, t GROUP BY term, docs),
    s AS (SELECT r, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))) AS score FROM p JOIN w USING (term), t),
    q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({terms}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
    x AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(score * repeats)::BIGINT AS score FROM q JOIN s USING (term) GROUP BY item_id, r),
    k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r)::INT AS rank, doc_id, score FROM x WHERE score > 0) SELECT * FROM k WHERE rank <= 10"""
