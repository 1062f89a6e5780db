"""File sources (S2, S4-S9, S11): explicit schemas, no inference.

Every reader returns a DataFrame; nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse as P

SEARCH_LOG_SCHEMA = T.StructType([
    T.StructField("commit", T.StringType()), T.StructField("val_bpb", T.StringType()),
    T.StructField("memory_gb", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("description", T.StringType()),
])

RUN_SCHEMA = T.StructType([
    T.StructField("condition", T.StringType()), T.StructField("target_base_letters", T.LongType()),
    T.StructField("actual_base_letters", T.DoubleType()), T.StructField("max_steps", T.LongType()),
    T.StructField("num_steps", T.LongType()), T.StructField("seed", T.LongType()),
    T.StructField("val_bpb", T.DoubleType()), T.StructField("total_eval_nats", T.DoubleType()),
    T.StructField("total_eval_bytes", T.LongType()), T.StructField("total_valid_tokens", T.LongType()),
    T.StructField("eval_base_letters", T.DoubleType()), T.StructField("bpbl", T.DoubleType()),
    T.StructField("total_tokens_M", T.DoubleType()), T.StructField("tokenizer", T.StringType()),
    T.StructField("architecture", T.StringType()), T.StructField("source", T.StringType()),
])

MANIFEST_KEYS = ["condition", "train_docs", "val_docs", "train_shards", "val_shard", "val_filename"]
SHARD_SCHEMA = T.StructType([T.StructField("text", T.StringType())])


def scan_condition(spark: SparkSession, root: str, condition: str | None = None,
                   split: str | None = None) -> DataFrame:
    """Shards written by ``write_shards`` (partitioned by condition / split / shard_id).

    Filters on the partition columns prune directories before any file is opened.
    """
    df = spark.read.option("basePath", root).parquet(root)
    if condition is not None:
        df = df.where(F.col("condition") == condition)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``key=value`` manifests, one row per file; split at the first '=', trimmed.

    Missing counts become 0; ``val_shard`` stays NULL when absent (S5 decides).
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    kv = (lines.where(F.instr("value", "=") > 0)
          .select("path", F.trim(F.substring_index("value", "=", 1)).alias("key"),
                  F.trim(F.expr("substr(value, instr(value, '=') + 1)")).alias("v")))
    wide = kv.groupBy("path").pivot("key", MANIFEST_KEYS).agg(F.first("v"))
    return wide.select(
        "path", "condition",
        F.coalesce(F.col("train_docs").cast("bigint"), F.lit(0)).alias("train_docs"),
        F.coalesce(F.col("val_docs").cast("bigint"), F.lit(0)).alias("val_docs"),
        F.coalesce(F.col("train_shards").cast("int"), F.lit(0)).alias("train_shards"),
        F.col("val_shard").cast("int").alias("val_shard"), "val_filename")


def resolve_val_shard(manifest: DataFrame | None, shard_ids: DataFrame) -> DataFrame:
    """The manifest's ``val_shard``; without a manifest, the highest shard index.

    ``shard_ids``: ``(condition, shard_id)``.  A manifest without the key is an error.
    """
    top = shard_ids.groupBy("condition").agg(F.max("shard_id").alias("max_shard"))
    if manifest is None:
        return top.select("condition", F.col("max_shard").alias("val_shard"))
    missing = F.raise_error(F.concat(F.lit("no val_shard in the manifest of "), F.col("condition"))).cast("int")
    return manifest.select("condition", F.coalesce("val_shard", missing).alias("val_shard"))


def scan_search_log(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated search log with a header row; blank lines skipped; all strings.

    Adds ``line_no`` (file name and line, so the order holds over several files) for
    first-on-ties rules.  Logs are small files, read whole.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "row")).where("line > 0")
    names = SEARCH_LOG_SCHEMA.fieldNames()
    cells = F.split("row", "\t")
    df = lines.where(F.trim("row") != "").select(
        *[F.get(cells, i).alias(c) for i, c in enumerate(names)], F.struct("file", "line").alias("line_no"))
    return df.where(F.trim("commit") != "").withColumn(
        "val_bpb", F.col("val_bpb").cast("double")).withColumn("memory_gb", F.col("memory_gb").cast("double"))


def scan_runs(spark: SparkSession, path: str) -> DataFrame:
    """The ``runs[]`` array of nested JSON result documents, one row per run.

    An unreadable file contributes no rows (``mode=DROPMALFORMED``).
    """
    schema = T.StructType([T.StructField("runs", T.ArrayType(RUN_SCHEMA))])
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return doc.select(F.inline_outer("runs")).where(F.col("condition").isNotNull())


def scan_seed_results(spark: SparkSession, path: str) -> DataFrame:
    """Per-condition parallel arrays ``seeds`` / ``bpbl`` -> ``(condition, seed, bpbl)``."""
    schema = T.MapType(T.StringType(), T.StructType([
        T.StructField("all_seeds", T.ArrayType(T.LongType())),
        T.StructField("all_bpbl", T.ArrayType(T.DoubleType())),
        T.StructField("val_bpb", T.ArrayType(T.DoubleType()))]))
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    per = raw.select(F.explode("m").alias("condition", "r"))
    return per.select("condition", F.inline(F.arrays_zip(F.col("r.all_seeds").alias("seed"),
                                                         F.col("r.all_bpbl").alias("bpbl"))))


def scan_training_logs(spark: SparkSession, path: str) -> DataFrame:
    """S8 + T13: one row per log file with the parsed metrics flattened."""
    logs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("log"))
    return logs.select("file_name", P.parse_metrics(F.col("log")).alias("m")).select("file_name", "m.*")


def scan_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary table; ``token_text`` decodes UTF-8 ignoring undecodable bytes."""
    v = spark.read.parquet(path)
    valid = F.try_validate_utf8(F.col("token").cast("string"))
    return v.withColumn("token_text", F.coalesce(valid, F.regexp_replace(
        F.make_valid_utf8(F.col("token").cast("string")), F.lit(chr(0xFFFD)), "")))
