"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver tables (or what Spark derives from them), over the whole
table (the run budgets and the window sample are features), and has an equivalent DuckDB statement in :mod:`marktext.plans.oracle` unless it
is iterative or uses Java-only regex features.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ambiguity as A
from ..operators import corpus as K
from ..operators import embed as E
from ..operators import packing as PK
from ..operators import runs as R
from ..operators import tokens as TK
from ..operators import validate as V
from ..sinks import publish as P
from ..sinks import writers as W
from ..sources import corpus as S
from ..sources import files as FS

Query = Callable[[SparkSession, str], DataFrame]


def collision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + A1 + A2: the flagship corpus ambiguity summary (zip alignment)."""
    return A.collision_summary(A.surface_forms(A.word_pairs(S.lifted_corpus(spark, sf_dir))))


def collision_summary_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same summary with every word keyed by itself stripped (robust alignment)."""
    pairs = A.word_pairs(S.lifted_corpus(spark, sf_dir), align=A.ALIGN_STRIP)
    return A.collision_summary(A.surface_forms(pairs))


def surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: one row per stripped form."""
    forms = A.surface_forms(A.word_pairs(S.lifted_corpus(spark, sf_dir)))
    return forms.select("stripped", forms.n_variants.cast("bigint").alias("n_variants"),
                        forms.n_words.cast("bigint").alias("n_words"), "first_doc", "first_pos")


def top_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + O1 + O3 + K5: top-50 forms with their first 10 sorted variants."""
    return A.top_ambiguous(A.word_pairs(S.lifted_corpus(spark, sf_dir)), k=50, n_shown=10)


def top_ambiguous_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: every variant of the top-50 forms, long form."""
    variants = A.variant_counts(A.word_pairs(S.lifted_corpus(spark, sf_dir)))
    return A.form_variants(variants, A.top_forms(A.forms_of(variants), 50))


def window_ambiguity_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: 10,000 sampled 128-word windows, seed 42."""
    corpus = S.lifted_corpus(spark, sf_dir)
    forms = A.surface_forms(A.word_pairs(corpus))
    return A.window_ambiguity_sampled(corpus, forms, window=128, n_samples=10_000, seed=42)


def window_ambiguity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the exact expectation of A4."""
    corpus = S.lifted_corpus(spark, sf_dir)
    forms = A.surface_forms(A.word_pairs(corpus))
    return A.window_ambiguity_exact(corpus, forms, window=128)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal, split and shard of every document per condition (keys only)."""
    return K.condition_index(K.condition_keys(S.lifted_corpus(spark, sf_dir)))


def _conditions(spark: SparkSession, sf_dir: str, conditions=K.CONDITIONS, split: str | None = None) -> DataFrame:
    """The texts of the conditions with their split, or those of one split."""
    return K.condition_texts(S.lifted_corpus(spark, sf_dir), conditions, split=split)


def atomic_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the atomic encoding (d3 text before filtering)."""
    corpus = S.lifted_corpus(spark, sf_dir)
    return corpus.select("doc_id", X.atomic_encode("vocalized").alias("text"))


def atomic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 property over the corpus: decode(encode(x)) == x, counted."""
    corpus = S.lifted_corpus(spark, sf_dir)
    dec = X.atomic_decode(X.atomic_encode("vocalized"))
    return corpus.agg(F.count(F.lit(1)).cast("bigint").alias("docs"),
                      F.count_if(dec == F.col("vocalized")).cast("bigint").alias("roundtrip_ok"),
                      F.sum(F.length(X.atomic_encode("vocalized"))).cast("bigint").alias("encoded_chars"))


def atomic_unit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 x T3: occurrences of every mapping entry in the encoded corpus."""
    return K.atomic_unit_histogram(S.lifted_corpus(spark, sf_dir))


def condition_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + P2 + W1 + W2 + W3: ordinal, split and shard of every document per condition."""
    return _index(spark, sf_dir)


def condition_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-condition manifest record."""
    return K.manifest(_index(spark, sf_dir))


def char_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-20 characters per condition, ties by first appearance."""
    conds = _conditions(spark, sf_dir)
    return A.char_distribution(conds, k=20, text_col="text", ordinal="doc_id",
                               group_cols=("condition",))


def base_letter_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base letters in the D1 validation shard."""
    return K.base_letter_total(_conditions(spark, sf_dir, ("d1",), "val"))


def embedding_group_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T22 + A18: mean intra-group cosine per label (closed form, no pairs)."""
    return E.group_cosine(S.scan_embeddings(spark, sf_dir), "label")


def embedding_overall_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19 + P10: mean / std of the per-label means and its reading."""
    return E.overall_cosine(E.group_cosine(S.scan_embeddings(spark, sf_dir), "label"))


def embedding_cosine_to_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of each label's vectors to all other vectors (closed form)."""
    return E.cosine_to_rest(S.scan_embeddings(spark, sf_dir), "label")


def embedding_group_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most common labels."""
    return E.group_frequency(S.scan_embeddings(spark, sf_dir), "label", 10)


def embedding_groups_by_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels ordered by mean cosine with the overall mean line."""
    return E.groups_by_cosine(E.group_cosine(S.scan_embeddings(spark, sf_dir), "label"), "label")


def embedding_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred 2-D PCA coordinates of every vector (rows-only check)."""
    coords, _ = E.pca_2d(S.scan_embeddings(spark, sf_dir))
    return coords


def embedding_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample covariance of every pair of embedding dimensions (one triangle)."""
    return E.covariance(S.scan_embeddings(spark, sf_dir)).withColumn("cov", F.round("cov", 9))


def embedding_explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance and share of the total along every principal axis."""
    return E.explained_variance(E.covariance(S.scan_embeddings(spark, sf_dir)))


#: Vocabulary of the registered training queries (the studied size), and the sizes whose fertility
#: is reported from one training.
BPE_VOCAB = 8192
BPE_SIZES = (512, 1024, 2048, 4096, 8192)


def _train_docs(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return _conditions(spark, sf_dir, (condition,)).where(F.col("split") == "train")


def _tokenizers(spark: SparkSession, sf_dir: str, conditions=K.CONDITIONS, split: str | None = "train"):
    """For each condition: its name, texts, chunk counts by split, train pretokens, and the merges learned from
    all of them.  The corpus is read once for all conditions' chunks; ``split`` leaves the other one out."""
    corpus = S.lifted_corpus(spark, sf_dir)
    cuts = K.condition_cuts(corpus, conditions).checkpoint()
    texts = K.condition_texts(corpus, conditions, split=split, cuts=cuts)
    counted = TK.chunk_counts(texts, group_cols=("condition", "split")).checkpoint()
    for cond in conditions:
        chunks = counted.where(F.col("condition") == cond)
        hist = TK.pretokens_of(chunks.where(F.col("split") == "train")).checkpoint()
        own = K.condition_texts(corpus, (cond,), split=split, cuts=cuts.where(F.col("condition") == cond))
        yield cond, own, chunks, hist, TK.bpe_train(hist, BPE_VOCAB)


def _merges(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    """The merges learned from all train documents of a condition."""
    return next(_tokenizers(spark, sf_dir, (condition,)))[-1]


def pretoken_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 + A10: pretoken frequencies over all d1 train documents (Java regex)."""
    return TK.pretoken_histogram(_train_docs(spark, sf_dir, "d1"))


def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: the exact BPE merges of the studied vocabulary, learned on the d1 train documents."""
    return _merges(spark, sf_dir, "d1")


def bpe_fertility_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + K3 per condition and vocabulary size: tokens, words and fertility of the train documents,
    all sizes from one training and one encoding of the distinct pretokens."""
    out = None
    for cond, _, chunks, hist, merges in _tokenizers(spark, sf_dir):
        row = TK.fertility_by_size(chunks, hist, merges, BPE_SIZES, text_col="chunk", n_col="n").select(F.lit(cond).alias("condition"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def bpe_tokenizer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2-B5 + A7 + A11 per condition: vocabulary size, roundtrip, fertility."""
    out = None
    for cond, train, chunks, hist, merges in _tokenizers(spark, sf_dir):
        vocab = TK.vocab_size(TK.vocab_table(spark, merges))
        fert = TK.fertility_by_size(chunks, hist, merges, (BPE_VOCAB,), text_col="chunk", n_col="n")
        # One-row inputs enter as scalar subqueries.
        row = TK.roundtrip_check(train, merges).select(
            F.lit(cond).alias("condition"), *[vocab.select(c).scalar().alias(c) for c in vocab.columns], "*",
            fert.select("fertility").scalar().alias("fertility"))
        out = row if out is None else out.unionByName(row)
    return out


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded UTF-8 byte length of every d3 vocabulary token (specials 0)."""
    merges = _merges(spark, sf_dir, "d3")
    return TK.token_bytes(TK.vocab_table(spark, merges))


def bpb_char_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + J5 + T9 + A8: unigram bits per byte and per base letter for d1/d2/d3."""
    return TK.char_unigram_bpb(_conditions(spark, sf_dir))


#: Budgets in base letters; one of all train letters is added from the table.
RUN_BUDGETS = (20_000, 50_000, 100_000, 200_000, 500_000)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_runs(_conditions(spark, sf_dir), budgets=RUN_BUDGETS, whole=True)


def corpus_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records (condition x budget x seed) derived from the corpus: T20, T21 inputs."""
    return _runs(spark, sf_dir)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 + J6 + T16: mean / sample std / n of BPBL per condition x budget grid cell."""
    return R.summary_by_budget(_runs(spark, sf_dir), budgets=None)


def run_scaling_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: chart-ready scaling points with the +/- std band."""
    return R.scaling_points(R.summary_by_budget(_runs(spark, sf_dir), budgets=None))


def run_robust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 + A15: mean, std, median, worst and best seed per condition and budget."""
    return R.robust_stats(_runs(spark, sf_dir), keys=("condition", "target_base_letters"))


def run_gap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 + P11: d1 vs d3 side by side per budget, encoding gap and winner."""
    return R.gap_table(R.summary_by_budget(_runs(spark, sf_dir), budgets=None))


def run_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (condition, budget, seed) grid with a fourth seed, minus completed runs."""
    return R.pending_runs(_runs(spark, sf_dir), budgets=None, seeds=(*R.SEEDS, 7))


def run_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T18 + T19: step calibration from the letters, words and (character) tokens of the val split."""
    val = (_conditions(spark, sf_dir, ("d1", "d3"), "val").groupBy("condition")
           .agg(F.sum(F.length("text")).alias("tokens"), F.sum(F.size(X.words("text"))).alias("words"),
                F.sum("letters").alias("letters")))
    return R.measured_calibration(val).select(
        "condition", "budget", F.round("bl_per_word", 9).alias("bl_per_word"),
        F.round("bl_per_token", 9).alias("bl_per_token"), "max_steps")


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 - V6 + V9 over the built conditions, with the per-condition roll-up.  The manifest comes
    from the ordinals, the counts held against it from the texts."""
    texts = _conditions(spark, sf_dir)
    return V.validate_all(V.content_checks(texts, K.manifest(_index(spark, sf_dir)), K.atomic_map(spark)),
                          V.char_distribution_check(texts))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Token counts of the d3 train documents (keys only, made once) and the packed rows."""
    train = _train_docs(spark, sf_dir, "d3")
    sizes = _token_sizes(train).checkpoint()
    docs = train.select("doc_id", PK.char_token_ids("text", bos_id=0).alias("ids"))
    return sizes, PK.pack_sequences(docs, order_col="doc_id", seq_len=2048, buffer_size=1000, sizes=sizes)


def _token_sizes(train: DataFrame) -> DataFrame:
    return train.select("doc_id", (F.length("text") + 1).cast("bigint").alias("n"))


def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6 + W6 + W7: best-fit packing of d3 train docs (character tokens, BOS first) into
    rows of 2048 + 1 tokens, per stretch of about four million tokens (rows-only)."""
    return _packed(spark, sf_dir)[1]


def pack_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that went into the packing and tokens placed; every row full."""
    sizes, packed = _packed(spark, sf_dir)
    return PK.pack_totals(packed, sizes, size_col="n")


def pack_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, the tokens that the packed rows hold of it and the stretch they span."""
    placed = PK.pack_placements(_token_sizes(_train_docs(spark, sf_dir, "d3")), order_col="doc_id")
    return placed.groupBy(F.col("ord").alias("doc_id")).agg(
        F.sum("tokens").cast("bigint").alias("tokens_placed"), F.min("start").alias("first_token"),
        F.max(F.col("start") + F.col("tokens")).alias("end_token"))


def published_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + K2 + S2 + S4 + S5 + V1-V3 + V5 + V6 + V9: the conditions written as shards with their manifest
    into a fresh folder, the pointer set, and both read back through the pointer and checked."""
    root = P.fresh_root(spark)
    corpus = S.lifted_corpus(spark, sf_dir)
    P.publish_conditions(K.build_conditions(corpus), K.manifest(_index(spark, sf_dir)), root)
    shards, manifest = P.read_published(spark, root)
    val = FS.resolve_val_shard(manifest, shards.select("condition", "shard_id"))
    return V.validate_all(V.shards_present(shards, manifest), V.val_shard_holds(shards, val),
                          V.content_checks(shards, manifest, K.atomic_map(spark)))


def d3_vocab_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + P9 + T10 + T11: which atomic units became single tokens of the d3 BPE vocabulary,
    per base letter (rows-only: the vocabulary comes from iterative training)."""
    merges = _merges(spark, sf_dir, "d3")
    return E.mapping_token_groups(K.atomic_map(spark), TK.vocab_table(spark, merges))


def bpb_token_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 + J5 + A9 per condition: bits per byte of a unigram over the condition's own tokens."""
    out = None
    for cond, texts, chunks, _, merges in _tokenizers(spark, sf_dir, split=None):
        row = TK.token_unigram_bpb(texts, merges, chunks).select(F.lit(cond).alias("condition"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def letter_embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + A18 + A19 + P10: atomic units that are single d3 tokens, per base letter, joined to the
    embeddings by token id."""
    merges = _merges(spark, sf_dir, "d3")
    return E.letter_cosine(K.atomic_map(spark), TK.vocab_table(spark, merges), S.scan_embeddings(spark, sf_dir))


def mark_letter_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + A18 + A20: marks against letters among the d1 tokens, joined to the embeddings."""
    merges = _merges(spark, sf_dir, "d1")
    return E.mark_letter_cosine(TK.vocab_table(spark, merges), S.scan_embeddings(spark, sf_dir))


def collision_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the human-readable collision report lines (header + top 20 forms)."""
    corpus = S.lifted_corpus(spark, sf_dir)
    pairs = A.word_pairs(corpus)
    forms = A.surface_forms(pairs)
    rate = A.window_ambiguity_sampled(corpus, forms, window=128, n_samples=10_000, seed=42)
    return W.collision_report_text(A.collision_summary(forms), A.top_ambiguous(pairs, k=20, n_shown=10), rate)


def collision_report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: the sorted variants of the top-50 forms in pages of at most 100."""
    variants = A.variant_counts(A.word_pairs(S.lifted_corpus(spark, sf_dir)))
    return A.variant_pages(variants, A.top_forms(A.forms_of(variants), 50), page_size=100)


def collision_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: the machine-readable collision report (scalars, window rate, top-50 forms)."""
    corpus = S.lifted_corpus(spark, sf_dir)
    variants = A.variant_counts(A.word_pairs(corpus))
    forms = A.forms_of(variants)
    top = A.top_forms(forms, 50)
    return W.collision_report_json(
        A.collision_summary(forms), top.select("rank", F.col("stripped").alias("word"), "n_variants"),
        A.form_variants(variants, top), window=128,
        window_rate=A.window_ambiguity_sampled(corpus, forms, window=128, n_samples=10_000, seed=42))


QUERIES: dict[str, Query] = {
    "collision_summary": collision_summary,
    "collision_summary_strip": collision_summary_strip,
    "surface_forms": surface_forms,
    "top_ambiguous": top_ambiguous,
    "top_ambiguous_variants": top_ambiguous_variants,
    "window_ambiguity_sampled": window_ambiguity_sampled,
    "window_ambiguity_exact": window_ambiguity_exact,
    "atomic_encode": atomic_encode,
    "atomic_roundtrip": atomic_roundtrip,
    "atomic_unit_histogram": atomic_unit_histogram,
    "condition_shards": condition_shards,
    "condition_manifest": condition_manifest,
    "char_distribution": char_distribution,
    "base_letter_total": base_letter_total,
    "embedding_group_cosine": embedding_group_cosine,
    "embedding_overall_cosine": embedding_overall_cosine,
    "embedding_cosine_to_rest": embedding_cosine_to_rest,
    "embedding_group_frequency": embedding_group_frequency,
    "embedding_groups_by_cosine": embedding_groups_by_cosine,
    "embedding_pca": embedding_pca,
    "embedding_covariance": embedding_covariance,
    "embedding_explained_variance": embedding_explained_variance,
    "pretoken_histogram": pretoken_histogram,
    "bpe_merges": bpe_merges,
    "bpe_tokenizer_report": bpe_tokenizer_report,
    "bpe_fertility_sizes": bpe_fertility_sizes,
    "token_bytes": token_bytes,
    "bpb_char_unigram": bpb_char_unigram,
    "corpus_runs": corpus_runs,
    "run_summary": run_summary,
    "run_scaling_points": run_scaling_points,
    "run_robust_stats": run_robust_stats,
    "run_gap_table": run_gap_table,
    "run_pending": run_pending,
    "run_calibration": run_calibration,
    "validation_report": validation_report,
    "pack_sequences": pack_sequences,
    "pack_totals": pack_totals,
    "pack_placements": pack_placements,
    "published_validation": published_validation,
    "d3_vocab_mapping": d3_vocab_mapping,
    "bpb_token_unigram": bpb_token_unigram,
    "letter_embedding_cosine": letter_embedding_cosine,
    "mark_letter_cosine": mark_letter_cosine,
    "collision_report_text": collision_report_text,
    "collision_report_pages": collision_report_pages,
    "collision_report_json": collision_report_json,
}
