"""Corpus sources (S1-S3, S10): parquet scans with explicit schemas.

``lifted_corpus`` derives a marked-script corpus from the driver's ``documents``
table with one ``translate`` (FIXTURES F1): Latin vowels become marks, consonants
become letters, everything else passes through. The same expression runs in DuckDB,
so every downstream operator has an SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import bound_batches

# ---------------------------------------------------------------------------
# FIXED VALUES — the lift used for oracle-checkable test corpora (FIXTURES F1).
#   from: a e i o u h U+00E9 U+00F3 U+00E8 b c d f g j k l m n p q r s t v w x y z U+00F1 U+00E7 U+00DF
#   to:   064E 0650 064F 064B 0652 0651 064D 064C 0670
#         0628 062A 062F 0641 062C 062D 0643 0644 0645 0646 0642 0635 0631
#         0633 0637 0639 0648 062E 064A 0632 0630 0634 0636
# ---------------------------------------------------------------------------
LIFT_FROM = "aeiouh" + chr(0xE9) + chr(0xF3) + chr(0xE8) + "bcdfgjklmnpqrstvwxyz" + chr(0xF1) + chr(0xE7) + chr(0xDF)
LIFT_TO_CODEPOINTS = [
    0x064E, 0x0650, 0x064F, 0x064B, 0x0652, 0x0651, 0x064D, 0x064C, 0x0670,
    0x0628, 0x062A, 0x062F, 0x0641, 0x062C, 0x062D, 0x0643, 0x0644, 0x0645, 0x0646,
    0x0642, 0x0635, 0x0631, 0x0633, 0x0637, 0x0639, 0x0648, 0x062E, 0x064A, 0x0632,
    0x0630, 0x0634, 0x0636,
]
LIFT_TO = "".join(chr(c) for c in LIFT_TO_CODEPOINTS)

DOCUMENTS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

CORPUS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("vocalized", T.StringType()),
    T.StructField("non_vocalized", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
])

EMBEDDINGS_SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


#: A table read in fewer splits than this is a few tens of megabytes at most; see ``spread_tiny``.
TINY_SPLITS = 8


def spread_tiny(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread a table of a few splits, such as the given test tables.

    One row group is read by one task, which would then do all per-row work (regexes,
    encoders) alone.  A table of ``TINY_SPLITS`` splits (of 4 MB at least) or more is read as it is, on a
    cluster of any size, so no corpus is ever shuffled for this.  The split count comes from
    file metadata; hash partitioning on the key keeps the redistribution deterministic.
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. Spark Connect): leave the plan as is
        return df
    if splits >= min(target, TINY_SPLITS):
        return df
    return df.repartition(target, key) if key else df.repartition(target)


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | None = None,
               key: str | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return spread_tiny(reader.parquet(table_path(sf_dir, name)), key)


def lift(text) -> F.Column:
    """Latin prose -> marked-script text (one JVM ``translate``)."""
    return F.translate(F.lower(text), LIFT_FROM, LIFT_TO)


def lifted_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 corpus ``(doc_id, vocalized, non_vocalized, lang, source)`` from ``documents``.

    ``doc_id`` is the ordinal (dense 0..n-1 in the driver tables).
    """
    bound_batches(spark)
    docs = read_table(spark, sf_dir, "documents", DOCUMENTS_SCHEMA, key="doc_id")
    voc = lift(F.col("text"))
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id"),
        voc.alias("vocalized"),
        X.strip_marks(voc).alias("non_vocalized"),
        "lang", "source",
    )


def scan_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Every parquet file under ``path`` (glob allowed) as one corpus table; with ``split`` only
    the files named ``{split}-*.parquet``."""
    reader = spark.read.schema(CORPUS_SCHEMA)
    return (reader.option("pathGlobFilter", f"{split}-*.parquet") if split else reader).parquet(path)


def scan_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding table; rows are selected later by join, never by driver lists."""
    return read_table(spark, sf_dir, "embeddings", EMBEDDINGS_SCHEMA, key="vec_id")
