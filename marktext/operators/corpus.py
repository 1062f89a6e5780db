"""Corpus build operators.

Row order is semantic: every corpus table carries an explicit ``ordinal`` (W1); the
tail split and shard slices are column arithmetic on it, never list positions.

Scale notes
-----------
* W1 ranks keys only (:mod:`.prefix`), whatever the ids look like.  ``condition_index`` never
  reads encoded text: the keep-predicates are JVM expressions over the source.
* The split needs no ordinal: the first val document of each condition is one value, and
  ``condition_texts`` compares ids with it, so texts are encoded where they are read and
  never shuffled.  Only the shard writer joins ordinals to texts, to each document's source once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars as C
from ..functions import text as X
from ..session import ensure_checkpoint_dir
from .prefix import dense_ordinal

CONDITIONS = ("d1", "d2", "d3")
VAL_RATIO = 0.02
DOCS_PER_SHARD = 50_000


# ---------------------------------------------------------------------------
# P1-P5
# ---------------------------------------------------------------------------
def drop_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Keep rows whose text is non-null and not only Python whitespace."""
    return df.where(X.is_not_blank(text_col))


def apply_condition(corpus: DataFrame, condition: str, text_col: str = "vocalized",
                    ordinal: str = "doc_id") -> DataFrame:
    """P1 + P2 + P1: filter blanks, encode for the condition, filter blanks again.

    Returns ``(condition, doc_id, text)``; d2 and d3 derive from the marked text.
    """
    base = drop_blank(corpus, text_col)
    enc = base.select(F.lit(condition).alias("condition"), F.col(ordinal).alias("doc_id"),
                      X.encode_condition(text_col, condition).alias("text"))
    return enc if condition == "d1" else drop_blank(enc, "text")


def cap_doc(text, max_chars: int = 10_000) -> Column:
    """First ``max_chars`` codepoints."""
    return F.substring(text if isinstance(text, Column) else F.col(text), 1, max_chars)


def limit_examples(df: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """First n rows by ordinal (dense); n <= 0 keeps all."""
    return df if n <= 0 else df.where(F.col(ordinal) < n)


# ---------------------------------------------------------------------------
# W1-W3
# ---------------------------------------------------------------------------
def n_val_docs(n: Column, ratio: float = VAL_RATIO) -> Column:
    """``max(1, int(n * ratio))`` with the float product, as the studied split does."""
    return F.greatest(F.lit(1), F.floor(n.cast("double") * F.lit(ratio)).cast("bigint"))


def condition_index(keys: DataFrame, ratio: float = VAL_RATIO, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """W1 + W2 + W3 over ``keys (condition, doc_id)``: ``(condition, doc_id, ordinal, split, shard_id)``.

    Train rows are cut in consecutive ``docs_per_shard`` slices; the val shard takes the
    next index.
    """
    # The ranks sample their keys before they place them: written once, the texts are not read again for that.
    ensure_checkpoint_dir(keys.sparkSession)
    ranked = dense_ordinal(keys.select("condition", "doc_id").checkpoint(), "doc_id", partition_cols=("condition",))
    totals = ranked.groupBy("condition").agg((F.max("ordinal") + 1).alias("_n"))
    n_train = F.greatest(F.col("_n") - n_val_docs(F.col("_n"), ratio), F.lit(0))
    is_val = F.col("ordinal") >= n_train
    # One row per condition.
    return ranked.join(F.broadcast(totals), "condition").select(
        "condition", "doc_id", "ordinal", F.when(is_val, "val").otherwise("train").alias("split"),
        F.when(is_val, F.ceil(n_train / F.lit(docs_per_shard)).cast("int"))
        .otherwise(F.floor(F.col("ordinal") / F.lit(docs_per_shard)).cast("int")).alias("shard_id"))


def split_and_shard(cond: DataFrame, ratio: float = VAL_RATIO,
                    docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """The index joined to a table ``(condition, doc_id, text, ...)``, as the shard writer needs it."""
    return cond.join(condition_index(cond, ratio, docs_per_shard), ["condition", "doc_id"])


def _keep(condition: str, text_col: str) -> Column:
    # Encoding rewrites letters and marks only, so a d3 text is blank exactly when its source is.  These
    # flags are made beside the texts: a filter on the source would be pushed below the expression that
    # makes it, which is then worked out once for each of the filter's terms and once more for the texts.
    return X.is_not_blank_stripped(text_col) if condition == "d2" else X.is_not_blank(text_col)


def _encoded(text_col: str, condition: Column, conditions: tuple[str, ...]) -> Column:
    """The text of a row's condition.  Fanned out before it is encoded, a row holds one text beside its
    source, and who reads no text runs no encoder; the encoder in Python gets null for the other conditions."""
    out = F
    for c in conditions:
        here = condition == c
        out = out.when(here, X.encode_condition(F.when(here, F.col(text_col)) if c == "d3" else text_col, c))
    return out


def condition_keys(corpus: DataFrame, conditions: tuple[str, ...] = CONDITIONS, text_col: str = "vocalized",
                   ordinal: str = "doc_id") -> DataFrame:
    """``(condition, doc_id)`` of all documents that the conditions keep; no encoder runs."""
    flags = F.array(*[F.struct(F.lit(c).alias("condition"), _keep(c, text_col).alias("keep")) for c in conditions])
    return (corpus.select(F.col(ordinal).alias("doc_id"), F.explode(flags).alias("v"))
            .where(F.col("v.keep")).select("v.condition", "doc_id"))


def condition_cuts(corpus: DataFrame, conditions: tuple[str, ...] = CONDITIONS, ratio: float = VAL_RATIO,
                   text_col: str = "vocalized", ordinal: str = "doc_id") -> DataFrame:
    """``(condition, _cut)``: the id of each condition's first val document."""
    index = condition_index(condition_keys(corpus, conditions, text_col, ordinal), ratio)
    return index.where(F.col("split") == "val").groupBy("condition").agg(F.min("doc_id").alias("_cut"))


def condition_texts(corpus: DataFrame, conditions: tuple[str, ...] = CONDITIONS, ratio: float = VAL_RATIO,
                    text_col: str = "vocalized", ordinal: str = "doc_id", split: str | None = None,
                    cuts: DataFrame | None = None) -> DataFrame:
    """``(condition, doc_id, text, letters, split)``: one scan, each document fans out where it is
    read; the split is decided by the id of each condition's first val document.  With ``split`` the
    rows of that split alone; documents that are in no condition's are not encoded.  ``cuts``: the
    :func:`condition_cuts`, if they are made already."""
    cuts = condition_cuts(corpus, conditions, ratio, text_col, ordinal) if cuts is None else cuts
    # Base letters from the source: stripping and atomic encoding both preserve the count
    # (each unit carries exactly one letter), so consumers never need the encoded text.
    if split is not None:
        wanted = (F.col(ordinal) >= cuts.select(F.min("_cut")).scalar() if split == "val"
                  else F.col(ordinal).isNull() | (F.col(ordinal) < cuts.select(F.max("_cut")).scalar()))
        corpus = corpus.where(wanted)
    flags = F.array(*[F.struct(F.lit(c).alias("condition"), _keep(c, "_source").alias("keep")) for c in conditions])
    kept = (corpus
            .select(F.col(ordinal).alias("doc_id"), X.count_base_letters(text_col).cast("bigint").alias("letters"),
                    F.col(text_col).alias("_source"))
            .select("doc_id", "letters", "_source", F.explode(flags).alias("v"))
            .where(F.col("v.keep")).select("v.condition", "doc_id", _encoded("_source", F.col("v.condition"), conditions).alias("text"), "letters"))
    # One row per condition.
    texts = kept.join(F.broadcast(cuts), "condition").select(
        "condition", "doc_id", "text", "letters",
        F.when(F.col("doc_id") >= F.col("_cut"), "val").otherwise("train").alias("split"))
    return texts if split is None else texts.where(F.col("split") == split)


def build_conditions(corpus: DataFrame, conditions: tuple[str, ...] = CONDITIONS,
                     ratio: float = VAL_RATIO, docs_per_shard: int = DOCS_PER_SHARD,
                     text_col: str = "vocalized", ordinal: str = "doc_id") -> DataFrame:
    """Everything the shard writer needs: ``(condition, doc_id, ordinal, text, split, shard_id, letters)``."""
    index = condition_index(condition_keys(corpus, conditions, text_col, ordinal), ratio, docs_per_shard)
    # A document meets its places, one for each condition that keeps it, before it is encoded: its source is
    # shuffled and sorted once, not every condition's text.  Texts are never the broadcast side.
    places = index.groupBy("doc_id").agg(F.collect_list(F.struct("condition", "ordinal", "split", "shard_id")).alias("_places"))
    docs = corpus.select(F.col(ordinal).alias("doc_id"), X.count_base_letters(text_col).cast("bigint").alias("letters"),
                         F.col(text_col).alias("_source"))
    return (docs.hint("merge").join(places, "doc_id")
            .select("doc_id", "letters", "_source", F.explode("_places").alias("p"))
            .select("p.condition", "doc_id", "p.ordinal", _encoded("_source", F.col("p.condition"), conditions).alias("text"),
                    "p.split", "p.shard_id", "letters"))


def build_condition(corpus: DataFrame, condition: str, ratio: float = VAL_RATIO,
                    docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """One condition's documents with ordinal, split and shard."""
    return build_conditions(corpus, (condition,), ratio, docs_per_shard)


def manifest(shards: DataFrame, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """One record of counts per condition."""
    train = F.count_if(F.col("split") == "train").cast("bigint")
    val = F.count_if(F.col("split") == "val").cast("bigint")
    agg = shards.groupBy("condition").agg(train.alias("train_docs"), val.alias("val_docs"))
    train_shards = F.ceil(F.col("train_docs") / F.lit(docs_per_shard)).cast("int")
    return agg.select(
        "condition", "train_docs", "val_docs", train_shards.alias("train_shards"),
        train_shards.alias("val_shard"),
        F.format_string("shard_%05d.parquet", train_shards).alias("val_filename"))


# ---------------------------------------------------------------------------
# A8, A12
# ---------------------------------------------------------------------------
def base_letter_total(val_texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Counting letters over a (val) shard."""
    return val_texts.agg(F.count(F.lit(1)).cast("bigint").alias("docs"),
                         F.coalesce(F.sum(X.count_base_letters(text_col)), F.lit(0))
                         .cast("bigint").alias("base_letters"))


# ---------------------------------------------------------------------------
# The atomic mapping dimension
# ---------------------------------------------------------------------------
def atomic_map(spark) -> DataFrame:
    """M4: 621 rows ``(seq, pua, codepoint, base, marks)`` — a constant dimension."""
    rows = []
    for seq, pua in C.atomic_mapping().items():
        base = seq[0] if seq[0] in C.MAP_LETTERS else None
        marks = list(seq[1:]) if base else [seq]
        rows.append((seq, pua, ord(pua), ord(pua) - C.PUA_BASE, base, marks))
    return spark.createDataFrame(
        rows, "seq string, pua string, codepoint int, slot int, base string, marks array<string>")


def atomic_unit_histogram(texts: DataFrame, text_col: str = "vocalized") -> DataFrame:
    """How often each mapping entry occurs when ``text_col`` is encoded.

    Units are counted where they are found (partial aggregation per task), then joined
    to the 621-row mapping dimension.
    """
    # Units are few and documents many: the closed form of the slot is worked out once a unit.
    units = texts.select(F.explode(X.marked_units(text_col)).alias("u")).groupBy("u").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    counts = units.select(X.unit_slot(F.col("u")).alias("slot"), "n").where(F.col("slot").isNotNull())
    dim = atomic_map(texts.sparkSession).select("slot", "seq", "codepoint", "base")
    return (counts.join(F.broadcast(dim), "slot")
            .select("slot", "codepoint", "seq", "base", "n"))
