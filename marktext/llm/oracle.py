"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

WORD_LIST = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _bits(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT)"


def _id(name: str) -> str:
    return f"coalesce(CAST({name} AS VARCHAR), '-')"


def mixing(levels: int = 3, fan: int = 64, most: int = 3) -> str:
    """The reduction tree with one recursive fold per level, for up to ``fan ** levels`` units a source."""
    ctes = [
        f"sized AS (SELECT doc_id AS id, source, CAST(len({WORD_LIST}) AS BIGINT) AS size FROM documents)",
        "units AS (SELECT id, source, size, count(*) AS copies FROM sized GROUP BY id, source, size)",
        "stats AS (SELECT source, CAST(sum(size * copies) AS BIGINT) AS source_size, count(*) AS n_units FROM units GROUP BY source)",
        "ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM stats)",
        # Sources by the level at which they reach their limit: the first k are at it.
        f"steps AS (SELECT CAST({most} * source_size AS DOUBLE) / weight AS reach, "
        f"sum({most} * source_size) OVER o - {most} * source_size AS mass, sum(weight) OVER o - weight AS taken, "
        "sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM ranked "
        "WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING))",
        "fill AS (SELECT CAST(total - mass AS DOUBLE) / (weights - taken) AS level FROM steps "
        "WHERE reach >= CAST(total - mass AS DOUBLE) / (weights - taken) ORDER BY reach, mass LIMIT 1)",
        f"targets AS (SELECT source, source_size, CAST(ceil(n_units / {fan}) AS BIGINT) AS n_groups, "
        f"least(weight * (SELECT level FROM fill), CAST({most} * source_size AS DOUBLE)) AS target FROM ranked)",
        "rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets)",
        "rated AS (SELECT u.*, r.source_size, r.target, r.n_groups, CAST(floor(rate) AS BIGINT) AS base, rate - floor(rate) AS frac, "
        f"{_bits(repr('mix'), _id('u.id'))} AS h FROM units u JOIN rates r ON u.source IS NOT DISTINCT FROM r.source)",
        "m0 AS (SELECT source, g, row_number() OVER (PARTITION BY source, g ORDER BY h, id NULLS FIRST, size, copies) AS rn, "
        "id, size, copies, w, w * frac AS x FROM (SELECT *, h % n_groups AS g, CAST(size * copies AS DOUBLE) AS w FROM rated "
        "WHERE size > 0 AND frac > 0))",
    ]
    for k in range(levels):
        meet = (f"SELECT f.source, f.g, m.rn, f.id AS fi, f.size AS fs, f.copies AS fc, f.w AS fw, m.id AS mi, m.size AS ms, "
                "m.copies AS mc, m.w AS mw, f.x + m.x AS s, least(f.w - f.x, m.x) AS up, least(f.x, m.w - m.x) AS down, "
                f"CAST({_bits(repr('mix'), _id('f.id'), _id('m.id'))} AS DOUBLE) / 4503599627370496 AS u "
                f"FROM f{k} f JOIN m{k} m ON m.source IS NOT DISTINCT FROM f.source AND m.g = f.g AND m.rn = f.rn + 1")
        case = f"SELECT *, CASE WHEN u * (up + down) < down THEN CASE WHEN s >= fw THEN 1 ELSE 2 END WHEN s <= mw THEN 3 ELSE 4 END AS k FROM ({meet})"
        pick = lambda when_m, when_f: f"CASE WHEN k IN (1, 3) THEN {when_m} ELSE {when_f} END"
        ctes += [
            f"f{k} AS (SELECT source, g, rn, id, size, copies, w, x, id AS eid, size AS esize, copies AS ecopies, -1 AS bit FROM m{k} WHERE rn = 1 "
            f"UNION ALL SELECT source, g, rn, {pick('mi', 'fi')}, {pick('ms', 'fs')}, {pick('mc', 'fc')}, {pick('mw', 'fw')}, "
            "CASE k WHEN 1 THEN s - fw WHEN 4 THEN s - mw ELSE s END, "
            f"{pick('fi', 'mi')}, {pick('fs', 'ms')}, {pick('fc', 'mc')}, CASE WHEN k IN (1, 4) THEN 1 ELSE 0 END FROM ({case}))",
            f"l{k} AS (SELECT * FROM f{k} QUALIFY row_number() OVER (PARTITION BY source, g ORDER BY rn DESC) = 1)",
            f"m{k + 1} AS (SELECT source, g // {fan} AS g, row_number() OVER (PARTITION BY source, g // {fan} ORDER BY g) AS rn, "
            f"id, size, copies, w, x FROM l{k})",
        ]
    decided = " UNION ALL ".join(f"SELECT source, eid AS id, esize AS size, ecopies AS copies, bit FROM f{k} WHERE bit >= 0" for k in range(levels))
    ctes.append(
        f"bits AS ({decided} UNION ALL SELECT source, id, size, copies, CASE WHEN {_bits(repr('mix'), _id('id'), repr('last'))} * w < "
        f"x * 4503599627370496 THEN 1 ELSE 0 END FROM l{levels - 1} UNION ALL SELECT source, id, size, copies, "
        "CASE WHEN h < frac * 4503599627370496 THEN 1 ELSE 0 END FROM rated WHERE NOT (size > 0 AND frac > 0))")
    ctes.append("each AS (SELECT *, unnest(range(copies)) AS nth FROM bits)")
    return "WITH RECURSIVE " + ",\n".join(ctes) + (
        "\nSELECT e.id AS doc_id, e.size, r.source_size, r.target, CAST((floor(r.rate) + e.bit) * e.size AS BIGINT) AS taken "
        "FROM each e JOIN rates r ON e.source IS NOT DISTINCT FROM r.source")


def preferences() -> str:
    """Common prefixes by turn; openings of up to 1000 conversations (one bucket) are paired alike."""
    said = "{'role': coalesce(role, ''), 'text': coalesce(text, '')}"
    rendered = "'<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10)"
    spans = ("coalesce(string_agg(CAST(off + skip AS VARCHAR) || ':' || CAST(off + n - 1 AS VARCHAR), ' ' ORDER BY turn, i) "
             "FILTER (WHERE role = 'assistant'), '')")

    def side(name: str) -> str:
        return (f"{name}p AS (SELECT pair, turn, i, p.role AS role, {rendered} AS t, length({rendered}) AS n, "
                f"length('<|im_start|>' || p.role || chr(10)) AS skip FROM (SELECT pair, turn, unnest({name}) AS p, "
                f"generate_subscripts({name}, 1) AS i FROM pieces WHERE NOT common AND {name} IS NOT NULL)),\n"
                f"{name}o AS (SELECT *, sum(n) OVER (PARTITION BY pair ORDER BY turn, i ROWS UNBOUNDED PRECEDING) - n AS off FROM {name}p),\n"
                f"{name}t AS (SELECT pair, string_agg(t, '' ORDER BY turn, i) AS txt, {spans} AS spans FROM {name}o GROUP BY pair)")

    return f"""
WITH turns AS (SELECT conv_id AS conv, coalesce(turn, 9223372036854775807) AS turn, list_sort(list(DISTINCT {said})) AS said
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
spoken AS (SELECT *, list_filter(said, lambda s: s.role = 'assistant') AS own FROM turns),
talk AS (SELECT conv, arg_min(said, turn) AS opening,
                sum(coalesce(list_sum(list_transform(own, lambda s: length(s.text))), 0)) AS words FROM spoken GROUP BY conv),
sib AS (SELECT *, row_number() OVER (PARTITION BY opening ORDER BY conv) - 1 AS k, count(*) OVER (PARTITION BY opening) AS n FROM talk),
two AS (SELECT opening, k // 2 AS k, arg_min(conv, (-words, conv)) AS chosen, arg_max(conv, (-words, conv)) AS rejected
        FROM sib GROUP BY opening, k // 2 HAVING count(*) = 2),
single AS (SELECT * FROM spoken WHERE conv NOT IN (SELECT chosen FROM two UNION ALL SELECT rejected FROM two)),
last AS (SELECT conv, max(turn) AS last FROM single WHERE len(own) > 0 GROUP BY conv),
stale AS (SELECT l.conv, l.last, coalesce(arg_max(s.said, s.turn), [{{'role': 'assistant', 'text': ''}}]) AS stale
          FROM last l LEFT JOIN single s ON s.conv = l.conv AND s.turn < l.last AND len(s.own) > 0 GROUP BY l.conv, l.last),
pairs AS (SELECT {{'a': chosen, 'b': rejected}} AS pair, chosen, rejected FROM two),
cs AS (SELECT p.pair, t.turn, t.said FROM pairs p JOIN turns t ON t.conv = p.chosen UNION ALL
       SELECT {{'a': s.conv, 'b': NULL}}, s.turn, s.said FROM single s JOIN last USING (conv)),
rs AS (SELECT p.pair, t.turn, t.said FROM pairs p JOIN turns t ON t.conv = p.rejected UNION ALL
       SELECT {{'a': s.conv, 'b': NULL}}, s.turn, CASE WHEN s.turn = st.last THEN st.stale ELSE s.said END FROM single s JOIN stale st USING (conv)),
sides AS (SELECT pair, turn, said AS c, NULL AS r FROM cs UNION ALL SELECT pair, turn, NULL, said FROM rs),
both_ AS (SELECT pair, turn, any_value(c) AS c, any_value(r) AS r FROM sides GROUP BY pair, turn),
split AS (SELECT pair, min(turn) FILTER (WHERE c IS DISTINCT FROM r) AS split FROM both_ GROUP BY pair),
pieces AS (SELECT b.*, s.split IS NULL OR b.turn < s.split AS common FROM both_ b JOIN split s ON s.pair = b.pair),
prompt AS (SELECT pair, string_agg({rendered}, '' ORDER BY turn, i) AS prompt FROM (SELECT pair, turn, unnest(c) AS p,
           generate_subscripts(c, 1) AS i FROM pieces WHERE common) GROUP BY pair),
cnt AS (SELECT pair, count(*) FILTER (WHERE common) AS n_common FROM pieces GROUP BY pair),
{side('c')},
{side('r')}
SELECT cnt.pair.a AS chosen_id, cnt.pair.b AS rejected_id, n_common, coalesce(prompt, '') AS prompt,
       coalesce(ct.txt, '') AS chosen_text, coalesce(ct.spans, '') AS chosen_spans,
       coalesce(rt.txt, '') AS rejected_text, coalesce(rt.spans, '') AS rejected_spans
FROM cnt LEFT JOIN prompt ON prompt.pair = cnt.pair LEFT JOIN ct ON ct.pair = cnt.pair LEFT JOIN rt ON rt.pair = cnt.pair"""


def filter_audit() -> str:
    """Failures of every document, the 120 orders by joining five letters, and counts by step."""
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT doc_id, part,
             [CASE WHEN len(ws) < 100 THEN 'A' END,
              CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' END,
              CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' END,
              CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
              CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END] AS fails FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, list_filter(fails, lambda x: x IS NOT NULL) AS fails, count(*) AS n,
             count(*) FILTER (coalesce(good, false)) AS good, count(*) FILTER (coalesce(toxic, false)) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM {letters} a(x) JOIN {letters} b(x) ON b.x <> a.x
      JOIN {letters} c(x) ON c.x NOT IN (a.x, b.x) JOIN {letters} d(x) ON d.x NOT IN (a.x, b.x, c.x)
      JOIN {letters} e(x) ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
t AS (SELECT m.*, array_to_string(o, '') AS filter_order, step, list_contains(fails, o[step]) AS own,
             list_has_any(fails, o[:step - 1]) AS before FROM m, s)
SELECT part, filter_order, step::INT AS step,
       coalesce(sum(n) FILTER (NOT own AND NOT before), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (own AND NOT before), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (own AND before), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (own AND len(fails) = 1), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (own AND NOT before), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (own AND NOT before), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(len(fails), 1)) FILTER (own), 0)::BIGINT AS shapley
FROM t GROUP BY part, filter_order, step"""


def phrases() -> str:
    """All n-grams of one to five words counted, cut, and the held ones dropped."""
    return r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
rest AS (SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c q WHERE q.lang = c.lang AND q.k > c.k AND 100 * q.a >= 100 * c.a
                        AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS j FROM rest),
s AS (SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, n,
             ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[:j], ' ')
                JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[j + 1:], ' ')
                JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       n::BIGINT AS n, score FROM b QUALIFY rank <= 2000"""
