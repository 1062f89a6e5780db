"""Helpers that write DuckDB SQL for the oracle side of every registered query.

Non-ASCII and control characters are emitted as ``chr(n)`` terms, so combining marks
never travel through an SQL parser as raw text.
"""

from __future__ import annotations

from ..functions import chars as C
from ..sources import corpus as S


def lit(s: str) -> str:
    """DuckDB expression evaluating to the string ``s``."""
    if s == "":
        return "''"
    parts: list[str] = []
    run: list[str] = []
    for ch in s:
        if 0x20 <= ord(ch) < 0x7F:
            run.append("''" if ch == "'" else ch)
        else:
            if run:
                parts.append("'" + "".join(run) + "'")
                run = []
            parts.append(f"chr({ord(ch)})")
    if run:
        parts.append("'" + "".join(run) + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def strip_marks(expr: str) -> str:
    return f"translate({expr}, {lit(C.MARKS)}, '')"


def words(expr: str) -> str:
    return f"regexp_extract_all({expr}, {lit(C.WORD_PATTERN)})"


def count_base_letters(expr: str) -> str:
    return f"(length({expr}) - length(translate({expr}, {lit(C.COUNT_LETTERS)}, '')))"


def lift(expr: str) -> str:
    return f"translate(lower({expr}), {lit(S.LIFT_FROM)}, {lit(S.LIFT_TO)})"


def corpus_ctes() -> str:
    """``corpus(doc_id, vocalized, non_vocalized, lang, source)`` as CTEs (no trailing comma)."""
    return (
        f"corpus0 AS (SELECT doc_id, {lift('text')} AS vocalized, lang, source "
        f"FROM documents WHERE doc_id IS NOT NULL), "
        f"corpus AS (SELECT doc_id, vocalized, {strip_marks('vocalized')} AS non_vocalized, lang, source "
        f"FROM corpus0)"
    )


def pairs_ctes(align: str = "zip") -> str:
    """``pairs(doc_id, pos, variant, stripped)`` after :func:`corpus_ctes`."""
    if align == "zip":
        return (
            f"wz AS (SELECT doc_id, {words('vocalized')} AS va, {words('non_vocalized')} AS na FROM corpus), "
            f"wi AS (SELECT doc_id, va, na, unnest(generate_series(1, least(len(va), len(na)))) AS i FROM wz), "
            f"pairs AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, va[i] AS variant, na[i] AS stripped FROM wi)"
        )
    return (
        f"wz AS (SELECT doc_id, {words('vocalized')} AS va FROM corpus), "
        f"wi AS (SELECT doc_id, va, unnest(generate_series(1, len(va))) AS i FROM wz), "
        f"pairs AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, va[i] AS variant, "
        f"{strip_marks('va[i]')} AS stripped FROM wi)"
    )


def forms_cte() -> str:
    """``forms(stripped, n_variants, n_words, first_doc, first_pos)`` after :func:`pairs_ctes`."""
    return (
        "firsts AS (SELECT stripped, doc_id AS first_doc, pos AS first_pos FROM "
        "(SELECT stripped, doc_id, pos, row_number() OVER (PARTITION BY stripped ORDER BY doc_id, pos) AS r "
        "FROM pairs) WHERE r = 1), "
        "forms AS (SELECT p.stripped, count(DISTINCT p.variant) AS n_variants, count(*) AS n_words, "
        "any_value(f.first_doc) AS first_doc, any_value(f.first_pos) AS first_pos "
        "FROM pairs p JOIN firsts f ON p.stripped = f.stripped GROUP BY p.stripped)"
    )


def mix32(x: str) -> str:
    """Same 32-bit finalizer as ``ambiguity._mix32`` in DuckDB syntax."""
    def step(v: str) -> str:
        return f"((xor({v}, {v} >> 16) * 73244475) % 4294967296)"
    a = step(x)
    b = step(a)
    return f"xor({b}, {b} >> 16)"


def sample_hash(seed: int, i: str, stream: int) -> str:
    return mix32(f"((CAST({seed} AS BIGINT) * 65537 + {i} * 4 + {stream}) % 4294967296)")


def sample_hash64(seed: int, i: str) -> str:
    return f"(({sample_hash(seed, i, 0)} % 2147483648) * 4294967296 + {sample_hash(seed, i, 2)})"


def is_not_blank(expr: str) -> str:
    return f"({expr} IS NOT NULL AND regexp_matches({expr}, {lit(C.NON_BLANK_PATTERN)}))"


def _li(cp: str) -> str:
    return f"(CASE WHEN {cp} <= 1594 THEN {cp} - 1569 ELSE {cp} - 1601 + 26 END)"


def _mi(cp: str) -> str:
    return f"(CASE WHEN {cp} = 1648 THEN 8 ELSE {cp} - 1611 END)"


def atomic_encode(expr: str) -> str:
    """T3 in DuckDB: leftmost-first units, closed-form slot, ``chr`` of the codepoint."""
    pat = lit("(?s)" + C.UNIT_PATTERN + "|.")
    c0, c1, c2 = "unicode(u)", "unicode(substr(u, 2, 1))", "unicode(substr(u, 3, 1))"
    body = (
        f"CASE WHEN length(u) = 1 AND contains({lit(C.MARKS)}, u) THEN chr({C.PUA_BASE} + {C.LONE_BLOCK} + {_mi(c0)}) "
        f"WHEN length(u) = 2 AND {c1} = {C.SHADDAH} THEN chr({C.PUA_BASE} + {C.SHADDAH_BLOCK} + 9 * {_li(c0)} + 8) "
        f"WHEN length(u) = 2 THEN chr({C.PUA_BASE} + 9 * {_li(c0)} + {_mi(c1)}) "
        f"WHEN length(u) = 3 THEN chr({C.PUA_BASE} + {C.SHADDAH_BLOCK} + 9 * {_li(c0)} + "
        f"(CASE WHEN {_mi(c2)} < 6 THEN {_mi(c2)} ELSE {_mi(c2)} - 1 END)) "
        f"ELSE u END"
    )
    return f"array_to_string(list_transform(regexp_extract_all({expr}, {pat}), lambda u: {body}), '')"


def atomic_decode(expr: str) -> str:
    """T4 in DuckDB: inverse closed form for slots 0..656 that are mapping values."""
    def letter(li: str) -> str:
        return f"chr(CASE WHEN {li} < 26 THEN 1569 + {li} ELSE 1601 + {li} - 26 END)"

    def mark(hi: str) -> str:
        return f"chr(CASE WHEN {hi} = 8 THEN 1648 ELSE 1611 + {hi} END)"

    s = f"(unicode(c) - {C.PUA_BASE})"
    r = f"({s} - {C.SHADDAH_BLOCK})"
    body = (
        f"CASE WHEN unicode(c) < {C.PUA_BASE} OR unicode(c) >= {C.PUA_BASE + C.N_SLOTS} THEN c "
        f"WHEN {s} < {C.SHADDAH_BLOCK} AND {s} % 9 = 6 THEN c "
        f"WHEN {s} < {C.SHADDAH_BLOCK} THEN {letter(f'({s} // 9)')} || {mark(f'({s} % 9)')} "
        f"WHEN {s} < {C.LONE_BLOCK} AND {r} % 9 = 8 THEN {letter(f'({r} // 9)')} || chr({C.SHADDAH}) "
        f"WHEN {s} < {C.LONE_BLOCK} THEN {letter(f'({r} // 9)')} || chr({C.SHADDAH}) || "
        f"{mark(f'(CASE WHEN {r} % 9 < 6 THEN {r} % 9 ELSE {r} % 9 + 1 END)')} "
        f"ELSE {mark(f'({s} - {C.LONE_BLOCK})')} END"
    )
    return f"array_to_string(list_transform(regexp_extract_all({expr}, '(?s).'), lambda c: {body}), '')"


def conditions_cte(ratio: float = 0.02, docs_per_shard: int = 50_000) -> str:
    """``conds(condition, doc_id, text)`` and ``shards(..., ordinal, split, shard_id)``."""
    strip = strip_marks("vocalized")
    enc = atomic_encode("vocalized")
    nb = is_not_blank("vocalized")
    return (
        f"conds AS (SELECT 'd1' AS condition, doc_id, vocalized AS text FROM corpus WHERE {nb} "
        f"UNION ALL SELECT 'd2', doc_id, t FROM (SELECT doc_id, {strip} AS t FROM corpus WHERE {nb}) "
        f"WHERE {is_not_blank('t')} "
        f"UNION ALL SELECT 'd3', doc_id, t FROM (SELECT doc_id, {enc} AS t FROM corpus WHERE {nb}) "
        f"WHERE {is_not_blank('t')}), "
        f"ranked AS (SELECT condition, doc_id, text, "
        f"row_number() OVER (PARTITION BY condition ORDER BY doc_id) - 1 AS ordinal, "
        f"count(*) OVER (PARTITION BY condition) AS n FROM conds), "
        f"shards AS (SELECT condition, doc_id, text, CAST(ordinal AS BIGINT) AS ordinal, "
        f"CASE WHEN ordinal >= greatest(n - greatest(1, CAST(floor(n * CAST({ratio} AS DOUBLE)) AS BIGINT)), 0) "
        f"THEN 'val' ELSE 'train' END AS split, "
        f"CAST(CASE WHEN ordinal >= greatest(n - greatest(1, CAST(floor(n * CAST({ratio} AS DOUBLE)) AS BIGINT)), 0) "
        f"THEN ceil(greatest(n - greatest(1, CAST(floor(n * CAST({ratio} AS DOUBLE)) AS BIGINT)), 0) / {docs_per_shard}) "
        f"ELSE floor(ordinal / {docs_per_shard}) END AS INTEGER) AS shard_id FROM ranked)"
    )
