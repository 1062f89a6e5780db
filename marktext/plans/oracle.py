"""DuckDB statements equivalent to the registered Spark queries (same column names).

The driver registers the parquet tables as views; every statement starts from them.
"""

from __future__ import annotations

from . import sqlgen as G


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _summary_select() -> str:
    return (
        "SELECT CAST(count(*) AS BIGINT) AS total_undiacritized_forms, "
        "CAST(sum(n_variants) AS BIGINT) AS total_diacritized_forms, "
        "CAST(count(*) FILTER (WHERE n_variants > 1) AS BIGINT) AS ambiguous_form_count, "
        "CAST(100.0 AS DOUBLE) * count(*) FILTER (WHERE n_variants > 1) / nullif(count(*), 0) AS ambiguous_form_pct, "
        "CAST(sum(n_variants) AS DOUBLE) / nullif(count(*), 0) AS avg_collision_rate, "
        "CAST(max(n_variants) AS BIGINT) AS max_collision_rate, "
        "CAST(coalesce(sum(n_words), 0) AS BIGINT) AS total_words_analyzed FROM forms"
    )


def collision_summary() -> str:
    return _with(G.corpus_ctes(), G.pairs_ctes("zip"), G.forms_cte()) + _summary_select()


def collision_summary_strip() -> str:
    return _with(G.corpus_ctes(), G.pairs_ctes("strip"), G.forms_cte()) + _summary_select()


def surface_forms() -> str:
    return _with(G.corpus_ctes(), G.pairs_ctes("zip"), G.forms_cte()) + (
        "SELECT stripped, CAST(n_variants AS BIGINT) AS n_variants, CAST(n_words AS BIGINT) AS n_words, "
        "first_doc, first_pos FROM forms")


def _top_ctes(k: int) -> str:
    return (
        f"top AS (SELECT stripped, n_variants, CAST(row_number() OVER "
        f"(ORDER BY n_variants DESC, first_doc, first_pos) AS INTEGER) AS rank FROM forms "
        f"ORDER BY n_variants DESC, first_doc, first_pos LIMIT {k})"
    )


def top_ambiguous() -> str:
    return _with(G.corpus_ctes(), G.pairs_ctes("zip"), G.forms_cte(), _top_ctes(50)) + (
        "SELECT t.rank, t.stripped AS word, CAST(t.n_variants AS BIGINT) AS n_variants, "
        "(SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT variant AS v FROM pairs p "
        " WHERE p.stripped = t.stripped ORDER BY v LIMIT 10)) AS top_variants FROM top t")


def top_ambiguous_variants() -> str:
    return _with(G.corpus_ctes(), G.pairs_ctes("zip"), G.forms_cte(), _top_ctes(50)) + (
        "SELECT DISTINCT t.rank, t.stripped AS word, p.variant FROM top t JOIN pairs p ON p.stripped = t.stripped")


def _sampled_ctes(window: int = 128, n_samples: int = 10_000, seed: int = 42) -> str:
    return ", ".join([
        "ords AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_ord FROM corpus)",
        f"samples AS (SELECT {G.sample_hash64(seed, 'i')} % (SELECT count(*) FROM corpus) AS doc_ord, "
        f"{G.sample_hash(seed, 'i', 1)} AS start_draw FROM range({n_samples}) t(i))",
        f"hit AS (SELECT s.start_draw, {G.words('c.vocalized')} AS w FROM samples s "
        f"JOIN ords o ON o.doc_ord = s.doc_ord JOIN corpus c ON c.doc_id = o.doc_id)",
        f"elig AS (SELECT * FROM hit WHERE len(w) >= {window})",
        f"toks AS (SELECT unnest(w[start_draw % (len(w) - {window} + 1) + 1 : "
        f"start_draw % (len(w) - {window} + 1) + {window}]) AS tok FROM elig)",
        f"amb AS (SELECT count(*) AS a FROM toks WHERE {G.strip_marks('tok')} IN "
        f"(SELECT stripped FROM forms WHERE n_variants > 1))",
        f"sampled AS (SELECT CAST(windows AS BIGINT) AS windows, CAST(windows * {window} AS BIGINT) AS tokens, "
        f"CAST(a AS BIGINT) AS ambiguous_tokens, "
        f"CASE WHEN windows > 0 THEN CAST(a AS DOUBLE) / (windows * {window}) ELSE 0.0 END AS rate "
        f"FROM (SELECT count(*) AS windows FROM elig) nw, amb)",
    ])


def window_ambiguity_sampled() -> str:
    return _with(G.corpus_ctes(), G.pairs_ctes("zip"), G.forms_cte(), _sampled_ctes()) + "SELECT * FROM sampled"


def window_ambiguity_exact(window: int = 128, digits: int = 9) -> str:
    return _with(
        G.corpus_ctes(), G.pairs_ctes("zip"), G.forms_cte(),
        f"el AS (SELECT doc_id, ws, len(ws) AS nw FROM (SELECT doc_id, {G.words('vocalized')} AS ws FROM corpus) "
        f"WHERE len(ws) >= {window})",
        "tk AS (SELECT doc_id, nw, unnest(generate_series(1, nw)) AS i, ws FROM el)",
        f"val AS (SELECT {G.strip_marks('ws[i]')} AS stripped, "
        f"least(i, {window}, nw - {window} + 1, nw - i + 1) / ({window} * (nw - {window} + 1)) AS v FROM tk)",
        "amb AS (SELECT sum(v) AS v FROM val WHERE stripped IN (SELECT stripped FROM forms WHERE n_variants > 1))",
        "n AS (SELECT count(*) AS n FROM el)",
    ) + (
        f"SELECT CAST(n AS BIGINT) AS eligible_docs, "
        f"round(CASE WHEN n > 0 THEN coalesce(v, 0.0) / n ELSE 0.0 END, {digits}) AS rate FROM n, amb")


def atomic_encode() -> str:
    return _with(G.corpus_ctes()) + f"SELECT doc_id, {G.atomic_encode('vocalized')} AS text FROM corpus"


def atomic_roundtrip() -> str:
    return _with(G.corpus_ctes(), f"e AS (SELECT vocalized, {G.atomic_encode('vocalized')} AS t FROM corpus)") + (
        f"SELECT CAST(count(*) AS BIGINT) AS docs, "
        f"CAST(count(*) FILTER (WHERE {G.atomic_decode('t')} = vocalized) AS BIGINT) AS roundtrip_ok, "
        f"CAST(sum(length(t)) AS BIGINT) AS encoded_chars FROM e")


def atomic_unit_histogram() -> str:
    e = G.atomic_encode("vocalized")
    return _with(G.corpus_ctes(), f"c AS (SELECT unnest(regexp_extract_all({e}, '(?s).')) AS ch FROM corpus)") + (
        f"SELECT CAST(unicode(ch) - {G.C.PUA_BASE} AS INTEGER) AS slot, CAST(unicode(ch) AS INTEGER) AS codepoint, "
        f"{G.atomic_decode('ch')} AS seq, "
        f"CASE WHEN unicode(ch) - {G.C.PUA_BASE} < {G.C.LONE_BLOCK} THEN substr({G.atomic_decode('ch')}, 1, 1) END AS base, "
        f"CAST(count(*) AS BIGINT) AS n FROM c "
        f"WHERE unicode(ch) >= {G.C.PUA_BASE} AND unicode(ch) < {G.C.PUA_BASE + G.C.N_SLOTS} GROUP BY ch")


def condition_shards() -> str:
    return _with(G.corpus_ctes(), G.conditions_cte()) + (
        "SELECT condition, doc_id, ordinal, split, shard_id FROM shards")


def condition_manifest(docs_per_shard: int = 50_000) -> str:
    ts = f"CAST(ceil(count(*) FILTER (WHERE split = 'train') / {docs_per_shard}) AS INTEGER)"
    return _with(G.corpus_ctes(), G.conditions_cte()) + (
        f"SELECT condition, CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS train_docs, "
        f"CAST(count(*) FILTER (WHERE split = 'val') AS BIGINT) AS val_docs, "
        f"{ts} AS train_shards, {ts} AS val_shard, printf('shard_%05d.parquet', {ts}) AS val_filename "
        f"FROM shards GROUP BY condition")


def char_distribution(k: int = 20) -> str:
    return _with(
        G.corpus_ctes(), G.conditions_cte(),
        "ex AS (SELECT condition, ordinal, unnest(regexp_extract_all(text, '(?s).')) AS ch, "
        "unnest(generate_series(0, length(text) - 1)) AS pos FROM shards)",
        "cnt AS (SELECT condition, ch, count(*) AS n, min(ordinal * 1000000000 + pos) AS first FROM ex "
        "GROUP BY condition, ch)",
    ) + (
        f"SELECT condition, rank, ch, codepoint, n FROM (SELECT condition, "
        f"CAST(row_number() OVER (PARTITION BY condition ORDER BY n DESC, first) AS INTEGER) AS rank, ch, "
        f"CAST(unicode(ch) AS INTEGER) AS codepoint, CAST(n AS BIGINT) AS n FROM cnt) WHERE rank <= {k}")


def base_letter_total() -> str:
    return _with(G.corpus_ctes(), G.conditions_cte()) + (
        f"SELECT CAST(count(*) AS BIGINT) AS docs, CAST(coalesce(sum({G.count_base_letters('text')}), 0) AS BIGINT) "
        f"AS base_letters FROM shards WHERE condition = 'd1' AND split = 'val'")


# The plain definition: every ordered pair of distinct vectors (small tables only).
_EMB_CTES = (
    "un AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum("
    "list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-10)) AS u FROM embeddings), "
    "pr AS (SELECT a.label, avg(list_inner_product(a.u, b.u)) AS m FROM un a JOIN un b "
    "ON a.label IS NOT DISTINCT FROM b.label AND a.vec_id <> b.vec_id GROUP BY a.label), "
    "cnt AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), "
    "gc AS (SELECT c.label, CAST(c.n AS BIGINT) AS n_vectors, round(pr.m, 9) AS mean_cosine "
    "FROM cnt c LEFT JOIN pr ON c.label IS NOT DISTINCT FROM pr.label)"
)


def embedding_covariance() -> str:
    return (
        "WITH v AS (SELECT vec_id, label, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, "
        "unnest(range(len(embedding))) AS i, rid FROM (SELECT *, row_number() OVER () AS rid FROM embeddings) WHERE embedding IS NOT NULL), "
        "c AS (SELECT rid, i, x - avg(x) OVER (PARTITION BY i) AS x FROM (SELECT v.x, v.i, rid FROM v)) "
        "SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.x * b.x) / (count(*) - 1), 9) AS cov "
        "FROM c a JOIN c b ON a.rid = b.rid AND a.i <= b.i GROUP BY a.i, b.i")


def embedding_group_cosine() -> str:
    return "WITH " + _EMB_CTES + " SELECT label, n_vectors, mean_cosine FROM gc"


def embedding_overall_cosine() -> str:
    return "WITH " + _EMB_CTES + (
        ", ov AS (SELECT count(*) AS n_groups, coalesce(avg(mean_cosine), 0.0) AS m, "
        "CASE WHEN count(*) > 1 THEN stddev_samp(mean_cosine) ELSE 0.0 END AS sd FROM gc "
        "WHERE mean_cosine IS NOT NULL) "
        "SELECT CAST(n_groups AS BIGINT) AS n_groups, round(m, 9) AS overall_mean, round(sd, 9) AS overall_std, "
        "CASE WHEN round(m, 9) < 0.15 THEN 'very_low' WHEN round(m, 9) < 0.3 THEN 'low' ELSE 'moderate' END "
        "AS interpretation FROM ov")


def embedding_cosine_to_rest() -> str:
    return "WITH " + _EMB_CTES + (
        "SELECT c.label, round(r.m, 9) AS cosine_to_rest FROM cnt c LEFT JOIN "
        "(SELECT a.label, avg(list_inner_product(a.u, b.u)) AS m FROM un a JOIN un b "
        "ON a.label IS DISTINCT FROM b.label GROUP BY a.label) r ON c.label IS NOT DISTINCT FROM r.label")


def embedding_group_frequency(k: int = 10) -> str:
    return (
        f"SELECT CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS rank, label, CAST(n AS BIGINT) AS n "
        f"FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) ORDER BY n DESC, label LIMIT {k}")


def embedding_groups_by_cosine() -> str:
    return "WITH " + _EMB_CTES + (
        " SELECT CAST(row_number() OVER (ORDER BY mean_cosine, label) AS INTEGER) AS position, label, mean_cosine, "
        "round((SELECT avg(mean_cosine) FROM gc WHERE mean_cosine IS NOT NULL), 9) AS overall_mean "
        "FROM gc WHERE mean_cosine IS NOT NULL")


def bpb_char_unigram() -> str:
    letters = (f"CASE WHEN condition = 'd3' THEN {G.count_base_letters(G.atomic_decode('text'))} "
               f"ELSE {G.count_base_letters('text')} END")
    return _with(
        G.corpus_ctes(), G.conditions_cte(),
        "ch AS (SELECT condition, split, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM shards)",
        "cnt AS (SELECT condition, split, ch, count(*) AS c FROM ch GROUP BY ALL)",
        "tr AS (SELECT condition, ch, c FROM cnt WHERE split = 'train')",
        "ev AS (SELECT condition, ch, c AS n_eval FROM cnt WHERE split = 'val')",
        "tot AS (SELECT condition, sum(c) AS N, count(*) AS V FROM tr GROUP BY condition)",
        "j AS (SELECT ev.condition, ev.n_eval, octet_length(encode(ev.ch)) AS nb, "
        "-ln((coalesce(tr.c, 0) + 1) / (coalesce(tot.N, 0) + coalesce(tot.V, 0) + 1)) AS loss FROM ev "
        "LEFT JOIN tr ON ev.condition = tr.condition AND ev.ch = tr.ch LEFT JOIN tot ON ev.condition = tot.condition)",
        "per AS (SELECT condition, sum(n_eval) AS eval_tokens, sum(n_eval * loss) AS nats, "
        "sum(n_eval * nb) AS total_bytes FROM j GROUP BY condition)",
        f"let AS (SELECT condition, sum({letters}) AS base_letters FROM shards WHERE split = 'val' GROUP BY condition)",
    ) + (
        "SELECT per.condition, CAST(eval_tokens AS BIGINT) AS eval_tokens, round(nats, 6) AS total_nats, "
        "CAST(total_bytes AS BIGINT) AS total_bytes, round(nats / (ln(2) * total_bytes), 9) AS bpb, "
        "CAST(base_letters AS BIGINT) AS base_letters, round(nats / (ln(2) * base_letters), 9) AS bpbl "
        "FROM per LEFT JOIN let ON per.condition = let.condition")


RUN_BUDGETS = (20_000, 50_000, 100_000, 200_000, 500_000)
RUN_SEEDS = (42, 137, 2024)


def _runs_ctes(budgets=RUN_BUDGETS, seeds=RUN_SEEDS) -> str:
    letters = (f"CASE WHEN condition = 'd3' THEN {G.count_base_letters(G.atomic_decode('text'))} "
               f"ELSE {G.count_base_letters('text')} END")
    blist = "(SELECT bl FROM bud)"
    return ", ".join([
        G.corpus_ctes(), G.conditions_cte(),
        f"sh AS (SELECT condition, doc_id, split, text, CAST({letters} AS BIGINT) AS letters FROM shards "
        f"WHERE condition IN ('d1', 'd3'))",
        "bud AS (SELECT list_sort(list_distinct([" + ", ".join(f"{b}::BIGINT" for b in budgets) + ", sum(letters)::BIGINT])) AS bl "
        "FROM sh WHERE condition = 'd1' AND split = 'train')",
        "seeds AS (SELECT unnest([" + ", ".join(str(x) for x in seeds) + "]) AS seed)",
        f"seeded AS (SELECT sh.*, seeds.seed, {G.mix32('((CAST(seeds.seed AS BIGINT) * 65537 + doc_id * 2) % 4294967296)')} "
        f"AS okey FROM sh, seeds WHERE split = 'train')",
        "rs AS (SELECT *, sum(letters) OVER (PARTITION BY condition, seed ORDER BY okey, doc_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - letters AS before FROM seeded)",
        "pre AS (SELECT * FROM (SELECT rs.*, len(list_filter(bl, lambda b: before >= b)) AS kmin, len(bl) AS nb FROM rs, bud) WHERE kmin < nb)",
        "ks AS (SELECT unnest(range(len(bl))) AS k FROM bud)",
        "pk AS (SELECT pre.*, ks.k FROM pre JOIN ks ON ks.k >= pre.kmin)",
        "dstats AS (SELECT condition, seed, k, count(*) AS num_steps, sum(letters) AS train_letters "
        "FROM pk GROUP BY ALL)",
        "cc AS (SELECT condition, seed, k, ch, count(*) AS c FROM (SELECT condition, seed, k, "
        "unnest(regexp_extract_all(text, '(?s).')) AS ch FROM pk) GROUP BY ALL)",
        "model AS (SELECT condition, seed, k, sum(c) AS N, count(*) AS V FROM cc GROUP BY ALL)",
        "ev AS (SELECT condition, ch, count(*) AS n_eval FROM (SELECT condition, "
        "unnest(regexp_extract_all(text, '(?s).')) AS ch FROM sh WHERE split = 'val') GROUP BY ALL)",
        "sc AS (SELECT m.condition, m.seed, m.k, ev.ch, ev.n_eval, m.N, m.V, coalesce(cc.c, 0) AS c "
        "FROM model m JOIN ev ON m.condition = ev.condition LEFT JOIN cc ON cc.condition = m.condition "
        "AND cc.seed = m.seed AND cc.k = m.k AND cc.ch = ev.ch)",
        "evals AS (SELECT condition, seed, k, sum(n_eval * -ln((c + 1) / (N + V + 1))) AS nats, "
        "sum(n_eval) AS toks, sum(n_eval * octet_length(encode(ch))) AS byts FROM sc GROUP BY ALL)",
        "vlet AS (SELECT condition, sum(letters) AS val_letters FROM sh WHERE split = 'val' GROUP BY ALL)",
        "tlet AS (SELECT condition, sum(letters) / count(*) AS lpd FROM sh WHERE split = 'train' GROUP BY ALL)",
        f"runs AS (SELECT e.condition, {blist}[e.k + 1] AS target_base_letters, "
        "CAST(d.train_letters AS DOUBLE) AS actual_base_letters, "
        f"CAST(floor({blist}[e.k + 1] / t.lpd) AS BIGINT) AS max_steps, "
        "CAST(d.num_steps AS INTEGER) AS num_steps, CAST(e.seed AS INTEGER) AS seed, "
        "round(e.nats / (ln(2) * e.byts), 6) AS val_bpb, round(e.nats, 4) AS total_eval_nats, "
        "CAST(e.byts AS BIGINT) AS total_eval_bytes, CAST(e.toks AS BIGINT) AS total_valid_tokens, "
        "round(e.toks * (v.val_letters / e.toks), 1) AS eval_base_letters, "
        "round(e.nats / (e.toks * (v.val_letters / e.toks) * ln(2)), 6) AS bpbl "
        "FROM evals e JOIN dstats d ON e.condition = d.condition AND e.seed = d.seed AND e.k = d.k "
        "JOIN vlet v ON e.condition = v.condition JOIN tlet t ON e.condition = t.condition)",
    ])


def _summary_ctes() -> str:
    return (
        "grid AS (SELECT unnest(['d1', 'd3']) AS condition, b AS target_base_letters FROM (SELECT unnest(bl) AS b FROM bud)), "
        "st AS (SELECT condition, target_base_letters, avg(bpbl) AS m, stddev_samp(bpbl) AS s, count(*) AS n, "
        "avg(actual_base_letters) AS x FROM runs GROUP BY ALL), "
        "summary AS (SELECT g.condition, CAST(g.target_base_letters AS BIGINT) AS target_base_letters, "
        "CAST(g.target_base_letters // 1000000 AS VARCHAR) || 'M' AS budget_label, round(m, 6) AS mean_bpbl, "
        "round(CASE WHEN coalesce(n, 0) >= 1 THEN coalesce(s, 0.0) END, 6) AS std_bpbl, "
        "CAST(coalesce(n, 0) AS BIGINT) AS n, round(x, 1) AS mean_actual_base_letters FROM grid g "
        "LEFT JOIN st ON g.condition = st.condition AND g.target_base_letters = st.target_base_letters)"
    )


def corpus_runs() -> str:
    return "WITH " + _runs_ctes() + " SELECT * FROM runs"


def run_summary() -> str:
    return "WITH " + _runs_ctes() + ", " + _summary_ctes() + " SELECT * FROM summary"


def run_scaling_points() -> str:
    return "WITH " + _runs_ctes() + ", " + _summary_ctes() + (
        " SELECT condition, target_base_letters, mean_actual_base_letters AS x, mean_bpbl AS y, "
        "mean_bpbl - std_bpbl AS y_lo, mean_bpbl + std_bpbl AS y_hi FROM summary WHERE mean_bpbl IS NOT NULL")


def run_robust_stats() -> str:
    return "WITH " + _runs_ctes() + (
        " SELECT condition, target_base_letters, CAST(count(*) AS BIGINT) AS n, round(avg(bpbl), 6) AS mean, "
        "round(coalesce(stddev_samp(bpbl), 0.0), 6) AS std, round(median(bpbl), 6) AS median, "
        "arg_max(seed, (bpbl, seed)) AS worst_seed, arg_min(seed, (bpbl, seed)) AS best_seed "
        "FROM runs GROUP BY condition, target_base_letters")


def run_gap_table() -> str:
    return "WITH " + _runs_ctes() + ", " + _summary_ctes() + (
        ", pv AS (SELECT target_base_letters, max(mean_bpbl) FILTER (WHERE condition = 'd1') AS d1, "
        "max(mean_bpbl) FILTER (WHERE condition = 'd3') AS d3 FROM summary GROUP BY target_base_letters) "
        "SELECT CAST(target_base_letters // 1000000 AS VARCHAR) || 'M' AS budget_label, target_base_letters, "
        "d1 AS d1_bpbl, d3 AS d3_bpbl, round(d3 - d1, 6) AS encoding_gap, "
        "round(100.0 * (d3 - d1) / d1, 2) AS encoding_gap_pct, "
        "CASE WHEN d1 IS NULL OR d3 IS NULL THEN 'N/A' WHEN d1 < d3 THEN 'D1' ELSE 'D3' END AS winner FROM pv")


def run_pending() -> str:
    seeds = ", ".join(str(x) for x in (*RUN_SEEDS, 7))
    return "WITH " + _runs_ctes() + (
        ", cells AS (SELECT unnest(['d1', 'd3']) AS condition, b AS target_base_letters FROM (SELECT unnest(bl) AS b FROM bud)), "
        f"grid AS (SELECT condition, target_base_letters, CAST(unnest([{seeds}]) AS INTEGER) AS seed FROM cells) "
        "SELECT * FROM grid ANTI JOIN (SELECT * FROM runs WHERE actual_base_letters >= target_base_letters) "
        "USING (condition, target_base_letters, seed)")


def run_calibration() -> str:
    from ..operators import runs as R
    budgets = ", ".join(str(b) for b in R.BUDGETS)
    return _with(
        G.corpus_ctes(), G.conditions_cte(),
        f"m AS (SELECT condition, sum(length(text)) AS tokens, sum(len({G.words('text')})) AS words "
        "FROM shards WHERE split = 'val' AND condition IN ('d1', 'd3') GROUP BY condition)",
        f"bl AS (SELECT CAST(sum({G.count_base_letters('text')}) AS DOUBLE) / sum(len({G.words('text')})) AS blpw "
        "FROM shards WHERE condition = 'd1' AND split = 'val')",
        f"bu AS (SELECT unnest([{budgets}]) AS budget)",
        "fe AS (SELECT condition, budget, blpw, blpw / (CAST(tokens AS DOUBLE) / words) AS blpt FROM m, bu, bl)",
    ) + (
        "SELECT condition, CAST(budget AS BIGINT) AS budget, round(blpw, 9) AS bl_per_word, round(blpt, 9) AS bl_per_token, "
        f"CAST(floor(budget / ({R.TOKENS_PER_STEP} * blpt)) AS BIGINT) AS max_steps FROM fe")


def _content_ctes(ratio: float = 0.02) -> tuple[str, ...]:
    from ..functions import chars as C
    marks, pua = (f"bool_or(regexp_matches(text, {G.lit(x)}))" for x in (C.MARK_CLASS, C.PUA_CLASS))
    letters = ("(SELECT unnest(list_concat(generate_series(1569, 1594), generate_series(1601, 1610))) AS l)")
    signs = "(SELECT unnest(list_concat(generate_series(1611, 1618), [1648])) AS m)"
    return (
        G.corpus_ctes(), G.conditions_cte(),
        # Expected sizes from the number of kept documents alone.
        f"sizes AS (SELECT condition, count(*) AS n, greatest(1, CAST(floor(count(*) * CAST({ratio} AS DOUBLE)) AS BIGINT)) AS n_val "
        f"FROM conds GROUP BY condition)",
        "cnt AS (SELECT condition, count(*) FILTER (WHERE split = 'train') AS tr, count(*) FILTER (WHERE split = 'val') AS va, "
        f"count(*) FILTER (WHERE text IS NULL OR text = '') AS bad, {marks} AS marks, {pua} AS pua FROM shards GROUP BY condition)",
        # The mapping's sequences by the rule: letter + mark, letter + shaddah + other mark, mark.
        f"seqs AS (SELECT chr(CAST(l AS INTEGER)) || chr(CAST(m AS INTEGER)) AS s FROM {letters}, {signs} UNION SELECT chr(CAST(l AS INTEGER)) || chr(1617) || chr(CAST(m AS INTEGER)) "
        f"FROM {letters}, {signs} WHERE m <> 1617 UNION SELECT chr(CAST(m AS INTEGER)) FROM {signs})",
        "content AS ("
        "SELECT condition, 'row_count_matches' AS \"check\", tr = n - n_val AND va = n_val AS passed, "
        "printf('%d train, %d val', tr, va) AS detail FROM cnt JOIN sizes USING (condition) "
        "UNION ALL SELECT condition, 'no_empty_texts', bad = 0, CAST(bad AS VARCHAR) FROM cnt "
        "UNION ALL SELECT condition, 'mapping_gate', (SELECT count(*) FROM seqs) >= 252, CAST((SELECT count(*) FROM seqs) AS VARCHAR) "
        "FROM cnt WHERE condition = 'd3' "
        "UNION ALL SELECT condition, 'mark_presence', CASE WHEN condition = 'd1' THEN marks WHEN condition = 'd2' THEN NOT marks "
        "ELSE pua END, printf('marks=%s pua=%s', marks, pua) FROM cnt)",
    )


_ROLLED_UP = (
    "SELECT condition, \"check\", passed, detail FROM ck UNION ALL "
    "SELECT condition, 'all', bool_and(passed), printf('%d/%d', count(*) FILTER (WHERE passed), count(*)) "
    "FROM ck GROUP BY condition")


def validation_report(k: int = 20) -> str:
    return _with(
        *_content_ctes(),
        "chs AS (SELECT condition, doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch, "
        "generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS pos FROM shards)",
        "per AS (SELECT condition, ch, count(*) AS n, min(struct_pack(d := doc_id, p := pos)) AS f FROM chs GROUP BY condition, ch)",
        "top AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY n DESC, f) AS r FROM per)",
        "ck AS (SELECT * FROM content "
        "UNION ALL SELECT condition, 'char_distribution', true, string_agg(printf('U+%04X', unicode(ch)), ' ' ORDER BY r) "
        f"FROM top WHERE r <= {k} GROUP BY condition)",
    ) + _ROLLED_UP


def published_validation(docs_per_shard: int = 50_000) -> str:
    n_train = f"CAST(ceil((n - n_val) / {docs_per_shard}) AS BIGINT)"
    return _with(
        *_content_ctes(),
        "ids AS (SELECT condition, count(DISTINCT (split, shard_id)) AS n_shards, "
        "min(shard_id) FILTER (WHERE split = 'val') AS v1, max(shard_id) FILTER (WHERE split = 'val') AS v2, "
        "max(shard_id) FILTER (WHERE split = 'train') AS t FROM shards GROUP BY condition)",
        "ck AS (SELECT * FROM content "
        f"UNION ALL SELECT condition, 'shards_present', n_shards = {n_train} + 1, CAST(n_shards AS VARCHAR) FROM ids JOIN sizes USING (condition) "
        f"UNION ALL SELECT condition, 'val_shard_holds', v1 = v2 AND v1 = {n_train} AND coalesce(t < v1, true), CAST({n_train} AS VARCHAR) "
        "FROM ids JOIN sizes USING (condition))",
    ) + _ROLLED_UP


def pack_placements() -> str:
    return _with(G.corpus_ctes(), G.conditions_cte()) + (
        "SELECT doc_id, CAST(length(text) + 1 AS BIGINT) AS tokens_placed, CAST(0 AS BIGINT) AS first_token, "
        "CAST(length(text) + 1 AS BIGINT) AS end_token FROM shards WHERE condition = 'd3' AND split = 'train'")


def collision_report_pages(page_size: int = 100) -> str:
    return _with(
        G.corpus_ctes(), G.pairs_ctes("zip"), G.forms_cte(), _top_ctes(50),
        "v AS (SELECT DISTINCT t.rank, t.stripped AS word, p.variant FROM top t JOIN pairs p ON p.stripped = t.stripped)",
        f"numbered AS (SELECT *, (row_number() OVER (PARTITION BY rank ORDER BY variant) - 1) // {page_size} AS page FROM v)",
    ) + (
        "SELECT rank, word, CAST(page AS BIGINT) AS page, count(*) AS n_variants, "
        "string_agg(variant, ' | ' ORDER BY variant) AS variants FROM numbered GROUP BY rank, word, page")


def pretoken_histogram() -> str:
    """The engine's pattern without look-ahead: in a run of white space before other characters the
    last blank is set off by a control character first, which no class of the pattern takes."""
    from ..functions import chars as C
    off = "chr(1)"
    arabic = G.lit(C.SPLIT_PATTERN.split("|")[0] + "|")
    rest = (f"'[^\\r\\n\\p{{L}}\\p{{N}}' || {off} || ']?\\p{{L}}+|\\p{{N}}{{1,2}}| ?[^\\s\\p{{L}}\\p{{N}}' || {off} || "
            f"']+[\\r\\n]*|\\s*[\\r\\n]|\\s+'")
    return _with(
        G.corpus_ctes(), G.conditions_cte(),
        f"docs AS (SELECT regexp_replace(text, '(\\s)([ \\t]\\S)', '\\1' || {off} || '\\2', 'g') AS t FROM shards "
        "WHERE condition = 'd1' AND split = 'train')",
        f"p AS (SELECT unnest(regexp_extract_all(t, {arabic} || {rest})) AS pretoken FROM docs)",
    ) + "SELECT pretoken, count(*) AS freq FROM p GROUP BY pretoken"


def pack_totals() -> str:
    return _with(G.corpus_ctes(), G.conditions_cte()) + (
        "SELECT CAST(sum(length(text) + 1) AS BIGINT) AS tokens_in, CAST(sum(length(text) + 1) AS BIGINT) AS tokens_placed, "
        "true AS rows_full FROM shards WHERE condition = 'd3' AND split = 'train'")


def collision_report_text() -> str:
    return _with(G.corpus_ctes(), G.pairs_ctes("zip"), G.forms_cte(), _top_ctes(20), _sampled_ctes(),
                 "sm AS (SELECT count(*) AS nf, sum(n_variants) AS nv, count(*) FILTER (WHERE n_variants > 1) AS na, "
                 "max(n_variants) AS mx, sum(n_words) AS nw FROM forms)") + (
        "SELECT CAST(0 AS INTEGER) AS line_no, 'Total unique undiacritized forms: ' || format('{:,}', nf) AS line FROM sm "
        "UNION ALL SELECT 1, 'Total unique diacritized forms: ' || format('{:,}', nv) FROM sm "
        "UNION ALL SELECT 2, 'Ambiguous forms (>1 diacritized variant): ' || format('{:,}', na) || ' (' || "
        "printf('%.1f', CAST(100.0 AS DOUBLE) * na / nf) || '%)' FROM sm "
        "UNION ALL SELECT 3, 'Average collision rate: ' || printf('%.2f', CAST(nv AS DOUBLE) / nf) FROM sm "
        "UNION ALL SELECT 4, 'Max collision rate: ' || CAST(mx AS VARCHAR) FROM sm "
        "UNION ALL SELECT 5, 'Total words analyzed: ' || format('{:,}', nw) FROM sm "
        "UNION ALL SELECT 6, 'Context-window ambiguous token rate (128-tok): ' || printf('%.2f', 100.0 * rate) || '%' FROM sampled "
        "UNION ALL SELECT 7, '' UNION ALL SELECT 8, 'Top 20 most ambiguous words:' "
        "UNION ALL SELECT t.rank + 8, '  ' || t.stripped || ' (' || CAST(t.n_variants AS VARCHAR) || ' variants): ' || "
        "(SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT variant AS v FROM pairs p "
        " WHERE p.stripped = t.stripped ORDER BY v LIMIT 10)) FROM top t")


ORACLE: dict[str, str] = {
    "collision_summary": collision_summary(),
    "collision_summary_strip": collision_summary_strip(),
    "surface_forms": surface_forms(),
    "top_ambiguous": top_ambiguous(),
    "top_ambiguous_variants": top_ambiguous_variants(),
    "window_ambiguity_sampled": window_ambiguity_sampled(),
    "window_ambiguity_exact": window_ambiguity_exact(),
    "atomic_encode": atomic_encode(),
    "atomic_roundtrip": atomic_roundtrip(),
    "atomic_unit_histogram": atomic_unit_histogram(),
    "condition_shards": condition_shards(),
    "condition_manifest": condition_manifest(),
    "char_distribution": char_distribution(),
    "base_letter_total": base_letter_total(),
    "embedding_covariance": embedding_covariance(),
    "embedding_group_cosine": embedding_group_cosine(),
    "embedding_overall_cosine": embedding_overall_cosine(),
    "embedding_cosine_to_rest": embedding_cosine_to_rest(),
    "embedding_group_frequency": embedding_group_frequency(),
    "embedding_groups_by_cosine": embedding_groups_by_cosine(),
    "bpb_char_unigram": bpb_char_unigram(),
    "corpus_runs": corpus_runs(),
    "run_summary": run_summary(),
    "run_scaling_points": run_scaling_points(),
    "run_robust_stats": run_robust_stats(),
    "run_gap_table": run_gap_table(),
    "run_pending": run_pending(),
    "run_calibration": run_calibration(),
    "validation_report": validation_report(),
    "collision_report_text": collision_report_text(),
    "pretoken_histogram": pretoken_histogram(),
    "pack_totals": pack_totals(),
    "pack_placements": pack_placements(),
    "published_validation": published_validation(),
    "collision_report_pages": collision_report_pages(),
}
