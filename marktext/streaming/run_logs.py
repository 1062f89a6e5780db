"""Incremental run records from training logs (K7 as a stream).

The studied project rewrites its results file after every finished run.  Here the log
folder is a file stream: each new log becomes a run record, appended once to a parquet
table through the file sink's commit log (exactly-once across restarts and executor
loss).  Summaries (A13 etc.) are ordinary batch queries over that table.

Log file names carry the run key: ``<condition>_<budget>_s<seed>.log``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import runs as R

NAME_PATTERN = r"^([A-Za-z0-9]+)_([0-9]+)_s([0-9]+)\.log$"


def run_records(logs: DataFrame, bl_per_token: dict[str, float]) -> DataFrame:
    """Parsed logs -> run records (T13 + P6 + T20 + T21); works on batch or stream input.

    ``logs``: ``(file_name, log)``.  Incomplete runs are dropped, as the studied loop does.
    """
    blpt = F.create_map(*[x for k, v in bl_per_token.items() for x in (F.lit(k), F.lit(v))])
    parsed = logs.select(
        F.regexp_extract("file_name", NAME_PATTERN, 1).alias("condition"),
        F.regexp_extract("file_name", NAME_PATTERN, 2).cast("bigint").alias("target_base_letters"),
        F.regexp_extract("file_name", NAME_PATTERN, 3).cast("int").alias("seed"),
        P.parse_metrics(F.col("log")).alias("m"))
    flat = parsed.select("condition", "target_base_letters", "seed", "m.*")
    done = R.complete_runs(flat).where(F.col("condition") != "")
    b = F.element_at(blpt, F.col("condition"))
    return done.select(
        "condition", "target_base_letters", "seed",
        F.col("num_steps").cast("bigint").alias("num_steps"),
        F.round(R.actual_base_letters(F.col("num_steps"), b), 1).alias("actual_base_letters"),
        F.round("val_bpb", 6).alias("val_bpb"), F.round("total_eval_nats", 4).alias("total_eval_nats"),
        F.coalesce(F.col("total_eval_bytes").cast("bigint"), F.lit(0)).alias("total_eval_bytes"),
        F.col("total_valid_tokens").cast("bigint").alias("total_valid_tokens"),
        F.round(F.col("total_valid_tokens") * b, 1).alias("eval_base_letters"),
        F.round(R.bpbl(F.col("total_eval_nats"), F.col("total_valid_tokens"), b), 6).alias("bpbl"),
        F.round("total_tokens_M", 1).alias("total_tokens_M"))


def start_run_log_stream(spark: SparkSession, log_dir: str, table_path: str, checkpoint: str,
                         bl_per_token: dict[str, float], available_now: bool = True):
    """Start the stream; returns the StreamingQuery (``availableNow`` drains and stops)."""
    logs = (spark.readStream.format("text").option("wholetext", True).load(log_dir)
            .select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file_name"),
                    F.col("value").alias("log")))
    writer = (run_records(logs, bl_per_token).writeStream.format("parquet")
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start(table_path)
