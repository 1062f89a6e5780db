"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_automaton import bpe_encode
from .chat_pairs import preference_rows
from .common import prepare, read
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .licenses import main_license, scan_licenses
from .line_dedup import line_dedup
from .maxent_lm import maxent_scores
from .mixing import mix_decisions
from .oracle import filter_audit as filter_audit_sql
from .oracle import mixing as mixing_sql
from .oracle import phrases as phrases_sql
from .oracle import preferences as preferences_sql
from .phrases import phrase_collocations
from .pii import pseudonymise_documents
from .quality import quality_rules
from .simhash import simhash_classes
from .suffix_dedup import suffix_dedup


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of all documents by two-pass Bloom filtering."""
    prepare(spark)
    return exact_dedup(read(spark, sf_dir, "documents")).drop("filtered")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources by weight takes from every document."""
    prepare(spark)
    return (mix_decisions(read(spark, sf_dir, "documents"))
            .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                    (F.col("times") * F.col("size")).alias("taken")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later places of repeated three-line windows."""
    prepare(spark)
    return line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the base filter and of the decision list learned from ``labels``."""
    prepare(spark)
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash class of every document: three-word shingles, at most two differing bits."""
    prepare(spark)
    return simhash_classes(read(spark, sf_dir, "documents"), shingle=3, bits=2).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path() -> str:
    """The public byte-level vocabulary; a parameter of the operators."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again with the public byte-level vocabulary."""
    prepare(spark)
    return bpe_digest(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def bpe_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Token number and digests of every text; the other columns are passed on."""
    return bpe_encode(docs, tokenizer, decoded_col="decoded").select(
        *[c for c in docs.columns if c != "text"],
        F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data under format-preserving pseudonyms.  The key of this
    query is a published constant; real use passes a secret."""
    prepare(spark)
    return pseudonymise_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), key="marktext demonstration key").select(
        "doc_id", "text", F.size("spans").cast("long").alias("n_found"), "spans")


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of all preference pairs of ``conversations``."""
    prepare(spark)
    spans = lambda mask: F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m["start"], m["stop"])), " ")
    return preference_rows(read(spark, sf_dir, "conversations")).select(
        "chosen_id", "rejected_id", "n_common", "prompt", "chosen_text", spans("chosen_mask").alias("chosen_spans"),
        "rejected_text", spans("rejected_mask").alias("rejected_spans"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document: the best one, and all matches."""
    prepare(spark)
    return (scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("best", main_license())
            .select("doc_id", F.col("best.l").alias("license"), (-F.col("best.d")).alias("dice"),
                    F.size("licenses").cast("long").alias("n_matches"), "licenses"))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum-entropy and unigram log-probabilities of every document; those whose
    crc32(doc_id) mod 7 is 2 are held out of training."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return maxent_scores(docs, ~held_out).select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every language, in all 120 orders."""
    prepare(spark)
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes covered by a 200-byte string that also starts elsewhere."""
    prepare(spark)
    return suffix_dedup(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of two to five words of every language."""
    prepare(spark)
    return phrase_collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    "op12_phrase_collocations": op12_phrase_collocations,
    "op11_filter_audit": op11_filter_audit,
    "op13_suffix_dedup": op13_suffix_dedup,
    "op6_maxent_lm": op6_maxent_lm,
    "op1_pii_pseudonyms": op1_pii_pseudonyms,
    "op4_preference_pairs": op4_preference_pairs,
    "op5_license_scan": op5_license_scan,
    "op9_bpe_automaton": op9_bpe_automaton,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op10_line_dedup": op10_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
}

ORACLE = {
    "op12_phrase_collocations": phrases_sql(),
    "op11_filter_audit": filter_audit_sql(),
    "op4_preference_pairs": preferences_sql(),
    "op2_mix_sources": mixing_sql(),
    "op10_line_dedup": r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS rank
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.rank, a.line AS l1, b.line AS l2, c.line AS l3
      FROM r a JOIN r b ON b.doc_id = a.doc_id AND b.rank = a.rank + 1
               JOIN r c ON c.doc_id = a.doc_id AND c.rank = a.rank + 2),
n AS (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, rank) AS place FROM w),
gone AS (SELECT DISTINCT doc_id, rank + k AS rank FROM n, (SELECT unnest([0, 1, 2]) AS k) WHERE place > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) AS text
         FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.no = l.no
                LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.rank = r.rank
         WHERE g.doc_id IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(n.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM r GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id) g USING (doc_id)""",
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM r""",
}
