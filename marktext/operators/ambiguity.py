"""Homograph ambiguity.

Scale notes
-----------
* J1 pairs words inside one row (``arrays_zip``); no join, no shuffle.
* A1 is one aggregation keyed by the stripped form.  ``count_distinct`` is planned as
  partial(stripped, variant) -> exchange(stripped) -> merge, so a hot form ships at most
  one row per *distinct* variant per map task, never one per occurrence.
* A3 top-k variants use a salted two-level top-n, so no task ever holds all variants
  of one (possibly huge) form.
* A4/A5 aggregate tokens per stripped form *before* joining the form table, so hot
  words are absorbed by partial aggregation; the sample table of A4 is bounded by
  ``n_samples`` and is the only side ever broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .prefix import dense_ordinal

ALIGN_ZIP = "zip"
ALIGN_STRIP = "strip"


# ---------------------------------------------------------------------------
# Word pairs
# ---------------------------------------------------------------------------
def word_pairs(corpus: DataFrame, align: str = ALIGN_ZIP, ordinal: str = "doc_id") -> DataFrame:
    """``(doc_id, pos, variant, stripped)``: one row per analysed word.

    ``zip``: word k of ``vocalized`` with word k of ``non_vocalized``; surplus words of the
    longer side are dropped (the studied definition, drifts after a marks-only word).
    ``strip``: every word of ``vocalized`` keyed by itself with marks stripped.
    """
    if align == ALIGN_ZIP:
        va, na = X.words("vocalized"), X.words("non_vocalized")
        docs = corpus.select(F.col(ordinal).alias("doc_id"), va.alias("va"), na.alias("na"))
        m = F.least(F.size("va"), F.size("na"))
        zipped = F.arrays_zip(F.slice("va", 1, m).alias("variant"), F.slice("na", 1, m).alias("stripped"))
        return (docs.select("doc_id", F.posexplode(zipped).alias("pos", "w"))
                .select("doc_id", "pos", F.col("w.variant").alias("variant"),
                        F.col("w.stripped").alias("stripped")))
    if align == ALIGN_STRIP:
        docs = corpus.select(F.col(ordinal).alias("doc_id"), X.words("vocalized").alias("va"))
        return (docs.select("doc_id", F.posexplode("va").alias("pos", "variant"))
                .select("doc_id", "pos", "variant", X.strip_marks("variant").alias("stripped")))
    raise ValueError(f"unknown align: {align}")


# ---------------------------------------------------------------------------
# A1 / A2
# ---------------------------------------------------------------------------
#: Positions in a document are below this.
_POSITIONS = 1 << 31


def _place() -> Column:
    """(doc_id, pos) as one decimal of the same order.  The minimum of a struct would have all words
    sorted by form and variant before the first aggregation; that of a number is kept in a hash table."""
    return F.col("doc_id").cast("decimal(20,0)") * F.lit(_POSITIONS).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")


def _place_parts(place: str) -> tuple[Column, Column]:
    """doc_id and pos of a place; negative ids too, since pos is never negative."""
    pos = F.pmod(F.col(place), F.lit(_POSITIONS).cast("decimal(10,0)"))
    doc = (F.col(place) - pos) / F.lit(_POSITIONS).cast("decimal(10,0)")
    return doc.cast("bigint").alias("first_doc"), pos.cast("int").alias("first_pos")


def surface_forms(pairs: DataFrame) -> DataFrame:
    """A1 ``(stripped, n_variants, n_words, first_doc, first_pos)`` — one row per form."""
    return (pairs.groupBy("stripped")
            .agg(F.count_distinct("variant").alias("n_variants"),
                 F.count(F.lit(1)).alias("n_words"),
                 F.min(_place()).alias("first"))
            .select("stripped", "n_variants", "n_words", *_place_parts("first")))


def variant_counts(pairs: DataFrame) -> DataFrame:
    """``(stripped, variant, n, first)``: every distinct variant once.  Consumers that need forms
    and their variants start from here, so the corpus is tokenised once and both share its
    exchange."""
    return pairs.groupBy("stripped", "variant").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first"))


def forms_of(variants: DataFrame) -> DataFrame:
    """A1 from :func:`variant_counts`."""
    return (variants.groupBy("stripped")
            .agg(F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("n_words"), F.min("first").alias("first"))
            .select("stripped", "n_variants", "n_words", *_place_parts("first")))


def collision_summary(forms: DataFrame) -> DataFrame:
    """A2: one row of corpus-level ambiguity figures over the A1 table."""
    n_forms = F.count(F.lit(1))
    amb = F.count_if(F.col("n_variants") > 1)
    total_var = F.sum("n_variants")
    return forms.agg(
        n_forms.cast("bigint").alias("total_undiacritized_forms"),
        total_var.cast("bigint").alias("total_diacritized_forms"),
        amb.cast("bigint").alias("ambiguous_form_count"),
        (F.lit(100.0) * amb / F.nullif(n_forms, F.lit(0))).alias("ambiguous_form_pct"),
        (total_var / F.nullif(n_forms, F.lit(0))).alias("avg_collision_rate"),
        F.max("n_variants").cast("bigint").alias("max_collision_rate"),
        F.coalesce(F.sum("n_words"), F.lit(0)).cast("bigint").alias("total_words_analyzed"),
    )


# ---------------------------------------------------------------------------
# A3 / O1 / O3: top ambiguous forms
# ---------------------------------------------------------------------------
def top_forms(forms: DataFrame, k: int = 50) -> DataFrame:
    """O1: the k forms with most variants, ties by first appearance; adds ``rank``.

    Planned as TakeOrderedAndProject (per-partition top-k, then merge of k rows each).
    """
    top = forms.orderBy(F.desc("n_variants"), "first_doc", "first_pos").limit(k)
    w = Window.orderBy(F.desc("n_variants"), "first_doc", "first_pos")
    # k rows only: the unpartitioned window runs over the limited result.
    return top.withColumn("rank", F.row_number().over(w).cast("int"))


def form_variants(variants: DataFrame, top: DataFrame) -> DataFrame:
    """K4 long form: every variant of the selected forms, ``(rank, word, variant)``, from
    :func:`variant_counts`.

    The top table is bounded by k, so it is the broadcast side of the join.
    """
    sel = F.broadcast(top.select(F.col("stripped"), "rank"))
    return variants.join(sel, "stripped").select("rank", F.col("stripped").alias("word"), "variant")


def variant_pages(variants: DataFrame, top: DataFrame, page_size: int = 100) -> DataFrame:
    """K4: ``(rank, word, page, n_variants, variants)``, the sorted variants of the selected forms
    in pages of at most ``page_size``, joined by ``" | "``.

    Variants are numbered by range partitions, so one form may hold any share of them; a page is
    the largest thing that is ever collected.
    """
    numbered = dense_ordinal(form_variants(variants, top), "variant", "_i", ("rank",))
    return (numbered.groupBy("rank", "word", F.floor(F.col("_i") / page_size).cast("bigint").alias("page"))
            .agg(F.count(F.lit(1)).alias("n_variants"),
                 F.array_join(F.sort_array(F.collect_list("variant")), " | ").alias("variants")))


def first_variants(variants: DataFrame, n: int = 10, salt_buckets: int = 64) -> DataFrame:
    """O3: the n smallest variants per form (codepoint order), salted two-level top-n."""
    salted = variants.withColumn("salt", F.pmod(F.xxhash64("variant"), F.lit(salt_buckets)))
    w1 = Window.partitionBy("rank", "salt").orderBy("variant")
    stage1 = salted.withColumn("r", F.row_number().over(w1)).where(F.col("r") <= n)
    w2 = Window.partitionBy("rank").orderBy("variant")
    stage2 = stage1.withColumn("r", F.row_number().over(w2)).where(F.col("r") <= n)
    return stage2.groupBy("rank").agg(
        F.array_join(F.sort_array(F.collect_list("variant")), " | ").alias("top_variants"))


def top_ambiguous(pairs: DataFrame, k: int = 50, n_shown: int = 10) -> DataFrame:
    """A3 + K5: ``(rank, word, n_variants, top_variants)`` for the k most ambiguous forms."""
    variants = variant_counts(pairs)
    top = top_forms(forms_of(variants), k)
    shown = first_variants(form_variants(variants, top), n_shown)
    return (top.join(shown, "rank")
            .select("rank", F.col("stripped").alias("word"), F.col("n_variants").cast("bigint"),
                    "top_variants"))


# ---------------------------------------------------------------------------
# A4: sampled context-window ambiguity
# ---------------------------------------------------------------------------
_M32 = 4294967296
_MIX = 73244475


def _mix32(x: Column) -> Column:
    """32-bit integer finalizer on BIGINT arithmetic (no overflow under ANSI)."""
    x = ((x.bitwiseXOR(F.shiftright(x, 16))) * _MIX) % _M32
    x = ((x.bitwiseXOR(F.shiftright(x, 16))) * _MIX) % _M32
    return x.bitwiseXOR(F.shiftright(x, 16))


def sample_hash(seed: int, i: Column, stream: int) -> Column:
    """Deterministic uniform 32-bit draw number ``i`` of ``stream`` (0 to 3) for ``seed``.

    The same arithmetic is written in the DuckDB oracle, so samples agree exactly.
    """
    x0 = (F.lit(seed).cast("bigint") * 65537 + i * 4 + stream) % _M32
    return _mix32(x0)


def sample_hash64(seed: int, i: Column) -> Column:
    """A 63-bit draw from streams 0 and 2, for corpora of any number of documents."""
    return (sample_hash(seed, i, 0) % 2147483648) * _M32 + sample_hash(seed, i, 2)


def ambiguous_keys(forms: DataFrame) -> DataFrame:
    return forms.where(F.col("n_variants") > 1).select("stripped")


def window_ambiguity_sampled(corpus: DataFrame, forms: DataFrame, window: int = 128,
                             n_samples: int = 10_000, seed: int = 42,
                             ordinal: str = "doc_id") -> DataFrame:
    """A4: draw ``n_samples`` documents uniformly (with replacement), skip those shorter than
    ``window`` words, take a uniform window start; rate = ambiguous / analysed tokens.

    ``ordinal`` is any unique key: documents are drawn by its dense rank (W1).  Returns
    ``(windows, tokens, ambiguous_tokens, rate)``.
    """
    ranked = dense_ordinal(corpus.select(F.col(ordinal).alias("_id")), "_id", "doc_ord")
    n_docs = ranked.select(F.count(F.lit(1))).scalar()
    i = F.col("id")
    samples = (corpus.sparkSession.range(n_samples)
               .select((sample_hash64(seed, i) % n_docs).alias("doc_ord"),
                       sample_hash(seed, i, 1).alias("start_draw")))
    # n_samples rows: a proven bound, so the samples are the broadcast side, before and after
    # they meet their document's key.
    drawn = ranked.join(F.broadcast(samples), "doc_ord").select("_id", "start_draw")
    docs = corpus.select(F.col(ordinal).alias("_id"), "vocalized")
    hit = docs.join(F.broadcast(drawn), "_id")
    wds = hit.select("start_draw", X.words("vocalized").alias("w"))
    # Short documents get a NULL window (no Filter on a derived column, which the
    # optimizer would push below the scan's redistribution).
    start = F.col("start_draw") % (F.size("w") - window + 1)
    win = F.when(F.size("w") >= window, F.slice("w", start + 1, window))
    tokens = wds.select(F.posexplode(win).alias("p", "tok"))
    # One aggregation: per form, tokens and window starts (p = 0 marks one window).
    per_form = tokens.groupBy(X.strip_marks("tok").alias("stripped")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == 0).alias("starts"))
    flagged = per_form.join(ambiguous_keys(forms).withColumn("amb", F.lit(True)), "stripped", "left")
    agg = flagged.agg(F.coalesce(F.sum(F.when(F.col("amb"), F.col("n"))), F.lit(0)).cast("bigint").alias("a"),
                      F.coalesce(F.sum("starts"), F.lit(0)).cast("bigint").alias("windows"))
    total = (F.col("windows") * window).cast("bigint")
    return agg.select(
        "windows", total.alias("tokens"), F.col("a").alias("ambiguous_tokens"),
        F.when(total > 0, F.col("a") / total).otherwise(F.lit(0.0)).alias("rate"))


# ---------------------------------------------------------------------------
# A5: exact expectation of A4
# ---------------------------------------------------------------------------
def window_ambiguity_exact(corpus: DataFrame, forms: DataFrame, window: int = 128,
                           ordinal: str = "doc_id", digits: int = 9) -> DataFrame:
    """A5: the value A4 estimates, with no sampling.

    In a document of ``W >= window`` words, position p lies in
    ``least(p+1, w, W-w+1, W-p)`` of the ``W-w+1`` windows; each eligible document
    contributes its mean window rate, and documents are averaged.
    """
    wds = corpus.select(X.words("vocalized").alias("ws"))
    nw = F.size("ws")
    toks = wds.select(nw.alias("nw"), F.posexplode(F.when(nw >= window, F.col("ws"))).alias("p", "tok"))
    nwc = F.col("nw")
    weight = F.least(F.col("p") + 1, F.lit(window), nwc - window + 1, nwc - F.col("p"))
    value = weight / (F.lit(window) * (nwc - window + 1))
    # One aggregation: per form, weighted value and eligible-document starts (p = 0).
    per_form = (toks.groupBy(X.strip_marks("tok").alias("stripped"))
                .agg(F.sum(value).alias("v"), F.count_if(F.col("p") == 0).alias("docs")))
    flagged = per_form.join(ambiguous_keys(forms).withColumn("amb", F.lit(True)), "stripped", "left")
    agg = flagged.agg(F.coalesce(F.sum(F.when(F.col("amb"), F.col("v"))), F.lit(0.0)).alias("v"),
                      F.coalesce(F.sum("docs"), F.lit(0)).cast("bigint").alias("eligible_docs"))
    n = F.col("eligible_docs")
    return agg.select("eligible_docs",
                      F.round(F.when(n > 0, F.col("v") / n).otherwise(F.lit(0.0)), digits).alias("rate"))


# ---------------------------------------------------------------------------
# Variant count lookup
# ---------------------------------------------------------------------------
def lookup_variant_counts(words_df: DataFrame, forms: DataFrame, word_col: str = "word") -> DataFrame:
    """n_variants of the stripped word, 0 when the form is unknown (left join)."""
    keyed = words_df.withColumn("stripped", X.strip_marks(word_col))
    return (keyed.join(forms.select("stripped", "n_variants"), "stripped", "left")
            .withColumn("n_variants", F.coalesce("n_variants", F.lit(0)).cast("bigint")))


# ---------------------------------------------------------------------------
# Character distribution
# ---------------------------------------------------------------------------
def char_counts(texts: DataFrame, text_col: str = "text", group_cols: tuple[str, ...] = (),
                ordinal: str | None = None) -> DataFrame:
    """Character counts ``(group..., ch, n, first_ord, first_pos)``.

    Each task counts its own documents by ``bincount`` over codepoints (a map-side combiner
    that emits at most groups x alphabet rows); Spark then merges the partial counts by
    key.  No row per character is ever materialised.  ``first_*`` is the earliest
    (ordinal, codepoint position) of the character when ``ordinal`` is given.
    """
    fields = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    out_schema = ", ".join([f"{g} {fields[g]}" for g in group_cols]
                           + ["ch string", "n bigint", "first_ord bigint", "first_pos bigint"])
    cols = [*group_cols, text_col] + ([ordinal] if ordinal else [])

    def count(batches):
        import numpy as np
        import pandas as pd
        acc: dict = {}
        for pdf in batches:
            pdf = pdf[pdf[text_col].notna()]
            if ordinal:  # the first place of a character is then its first one in the batch, block by block
                pdf = pdf.sort_values(ordinal, kind="stable")
            parts = pdf.groupby(list(group_cols), dropna=False, sort=False) if group_cols else [((), pdf)]
            for key, part in parts:
                g = tuple(None if pd.isna(v) else v for v in key)
                texts_of, ords_of = part[text_col].tolist(), part[ordinal].to_numpy() if ordinal else None
                for block in X.text_blocks(texts_of):
                    txts = texts_of[block]
                    code = np.frombuffer("".join(txts).encode("utf-32-le", "surrogatepass"), np.uint32)
                    totals = np.bincount(code)
                    seen = np.flatnonzero(totals)
                    if ordinal:
                        first = np.zeros(len(totals), np.int64)
                        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
                        ends = np.cumsum(np.fromiter(map(len, txts), np.int64, len(txts)))
                        doc = np.searchsorted(ends, first[seen], side="right")
                        ords = ords_of[block][doc].tolist()
                        places = (first[seen] - np.concatenate(([0], ends))[doc]).tolist()
                    else:
                        ords = places = [None] * len(seen)
                    for cp, n, *where in zip(seen.tolist(), totals[seen].tolist(), ords, places):
                        e = acc.get((*g, cp))
                        if e is None:
                            acc[(*g, cp)] = [n, *where]
                        else:
                            e[0] += n
                            if ordinal and where[0] < e[1]:
                                e[1:] = where
        rows = [(*k[:-1], chr(k[-1]), *v) for k, v in acc.items()]
        names = [*group_cols, "ch", "n", "first_ord", "first_pos"]
        pdf = pd.DataFrame(rows, columns=names)
        pdf = pdf.astype({"n": "int64", "first_ord": "Int64", "first_pos": "Int64"})
        yield pdf

    partial = texts.select(*cols).mapInPandas(count, out_schema)
    return (partial.groupBy(*group_cols, "ch")
            .agg(F.sum("n").cast("bigint").alias("n"),
                 F.min(F.struct("first_ord", "first_pos")).alias("f"))
            .select(*group_cols, "ch", "n", F.col("f.first_ord").alias("first_ord"),
                    F.col("f.first_pos").alias("first_pos")))


def char_distribution(texts: DataFrame, k: int = 20, text_col: str = "text",
                      ordinal: str = "doc_id", group_cols: tuple[str, ...] = ()) -> DataFrame:
    """The k most frequent characters per group, ties by first appearance.

    ``(group..., rank, ch, codepoint, n)``; the per-group top-k window runs over at most
    (groups x alphabet) merged rows.
    """
    counts = char_counts(texts, text_col, group_cols, ordinal)
    w = Window.partitionBy(*group_cols).orderBy(F.desc("n"), "first_ord", "first_pos")
    ranked = counts.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    return ranked.select(*group_cols, "rank", "ch", F.ascii("ch").alias("codepoint"),
                         F.col("n").cast("bigint").alias("n"))
