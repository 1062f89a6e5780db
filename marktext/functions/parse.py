"""Log and source-text parsing (T13-T15) as regex expressions over text columns.

Every pattern runs in ``(?md)`` mode: multi-line, and ``\\n`` as the only line end, so a
CRLF line keeps its ``\\r`` exactly as the studied Python patterns see it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import PYWS_CLASS

_WS = "[" + PYWS_CLASS + "]"

# ---------------------------------------------------------------------------
# FIXED VALUES — metric lines printed by a training run ("key: value"), with the
# value pattern each key accepts:
#   val_bpb [0-9.]+ ; peak_vram_mb [0-9.]+ ; total_tokens_M [0-9.]+ ; num_params_M [0-9.]+ ;
#   training_seconds [0-9.]+ ; total_eval_nats [0-9.]+ ; total_eval_bytes [0-9]+ ;
#   total_valid_tokens [0-9]+ ; num_steps [0-9]+
# Hyper-parameter keys (source lines "KEY = value"):
#   ASPECT_RATIO HEAD_DIM WINDOW_PATTERN TOTAL_BATCH_SIZE EMBEDDING_LR UNEMBEDDING_LR
#   MATRIX_LR SCALAR_LR WEIGHT_DECAY ADAM_BETAS WARMUP_RATIO WARMDOWN_RATIO FINAL_LR_FRAC
#   DEPTH DEVICE_BATCH_SIZE
# Typed extraction: key, value pattern, default, type
#   ASPECT_RATIO \d+ 64 int; HEAD_DIM \d+ 96 int; WINDOW_PATTERN "([^"]+)" SS str;
#   TOTAL_BATCH_SIZE (2\*\*\d+|\d+) 2**15 str (reported as TOTAL_BATCH_SIZE_EXPR);
#   EMBEDDING_LR [\d.]+ 0.6 float; UNEMBEDDING_LR [\d.]+ 0.004 float;
#   MATRIX_LR [\d.]+ 0.045 float; SCALAR_LR [\d.]+ 0.5 float; WEIGHT_DECAY [\d.]+ 0.2 float;
#   ADAM_BETAS (\([\d.,\s]+\)) (0.8, 0.95) str; WARMUP_RATIO [\d.]+ 0.0 float;
#   WARMDOWN_RATIO [\d.]+ 0.5 float; FINAL_LR_FRAC [\d.]+ 0.0 float; DEPTH \d+ 2 int;
#   DEVICE_BATCH_SIZE \d+ 16 int
# ---------------------------------------------------------------------------
METRIC_PATTERNS = {
    "val_bpb": "[0-9.]+", "peak_vram_mb": "[0-9.]+", "total_tokens_M": "[0-9.]+",
    "num_params_M": "[0-9.]+", "training_seconds": "[0-9.]+", "total_eval_nats": "[0-9.]+",
    "total_eval_bytes": "[0-9]+", "total_valid_tokens": "[0-9]+", "num_steps": "[0-9]+",
}
PARAM_KEYS = ["ASPECT_RATIO", "HEAD_DIM", "WINDOW_PATTERN", "TOTAL_BATCH_SIZE", "EMBEDDING_LR",
              "UNEMBEDDING_LR", "MATRIX_LR", "SCALAR_LR", "WEIGHT_DECAY", "ADAM_BETAS", "WARMUP_RATIO",
              "WARMDOWN_RATIO", "FINAL_LR_FRAC", "DEPTH", "DEVICE_BATCH_SIZE"]
_D = "[0-9]"
TYPED_PARAMS = [
    ("ASPECT_RATIO", "ASPECT_RATIO", f"({_D}+)", "64", "int"),
    ("HEAD_DIM", "HEAD_DIM", f"({_D}+)", "96", "int"),
    ("WINDOW_PATTERN", "WINDOW_PATTERN", '"([^"]+)"', "SS", "string"),
    ("TOTAL_BATCH_SIZE_EXPR", "TOTAL_BATCH_SIZE", rf"(2\*\*{_D}+|{_D}+)", "2**15", "string"),
    ("EMBEDDING_LR", "EMBEDDING_LR", r"([0-9.]+)", "0.6", "double"),
    ("UNEMBEDDING_LR", "UNEMBEDDING_LR", r"([0-9.]+)", "0.004", "double"),
    ("MATRIX_LR", "MATRIX_LR", r"([0-9.]+)", "0.045", "double"),
    ("SCALAR_LR", "SCALAR_LR", r"([0-9.]+)", "0.5", "double"),
    ("WEIGHT_DECAY", "WEIGHT_DECAY", r"([0-9.]+)", "0.2", "double"),
    ("ADAM_BETAS", "ADAM_BETAS", r"(\([0-9.," + PYWS_CLASS + r"]+\))", "(0.8, 0.95)", "string"),
    ("WARMUP_RATIO", "WARMUP_RATIO", r"([0-9.]+)", "0.0", "double"),
    ("WARMDOWN_RATIO", "WARMDOWN_RATIO", r"([0-9.]+)", "0.5", "double"),
    ("FINAL_LR_FRAC", "FINAL_LR_FRAC", r"([0-9.]+)", "0.0", "double"),
    ("DEPTH", "DEPTH", f"({_D}+)", "2", "int"),
    ("DEVICE_BATCH_SIZE", "DEVICE_BATCH_SIZE", f"({_D}+)", "16", "int"),
]


def _first(text: Column, pattern: str) -> Column:
    """First capture of ``pattern`` or NULL (``regexp_extract`` gives '' on no match)."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def metric_value(log: Column, key: str) -> Column:
    """T13 for one key: first ``key: value`` line, as double; NULL when absent."""
    pat = f"(?md)^{key}:{_WS}+({METRIC_PATTERNS[key]})$"
    return _first(log, pat).try_cast("double")


def parse_metrics(log: Column) -> Column:
    """Struct of the nine metrics (NULL for a missing key, first match wins)."""
    return F.struct(*[metric_value(log, k).alias(k) for k in METRIC_PATTERNS])


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(f"^{_WS}+|{_WS}+$"), "")


def extract_params(sources: DataFrame, source_col: str = "source", keys=PARAM_KEYS, strict: bool = False) -> DataFrame:
    """``(…, key, value, found)`` for every key of every source text.

    ``value`` is the first ``^KEY\\s*=\\s*(.+)$`` line, stripped; ``found`` is false when
    the key is absent, which is an error when ``strict``.
    """
    src = F.col(source_col)
    items = [F.struct(F.lit(k).alias("key"),
                      F.nullif(_strip(F.regexp_extract(src, f"(?md)^{k}{_WS}*={_WS}*(.+)$", 1)),
                               F.lit("")).alias("value"),
                      F.regexp_like(src, F.lit(f"(?md)^{k}{_WS}*={_WS}*.+$")).alias("found"))
             for k in keys]
    found = F.col("_kv.found")
    if strict:
        found = F.when(found, True).otherwise(F.raise_error(F.concat(F.lit("missing parameter "), F.col("_kv.key"))).cast("boolean"))
    return sources.withColumn("_kv", F.explode(F.array(*items))).select(
        *[c for c in sources.columns if c != source_col], "_kv.key", "_kv.value", found.alias("found"))


def extract_params_typed(source: Column) -> Column:
    """Struct of the 15 typed parameters with the narrower patterns and defaults."""
    fields = []
    for name, key, pat, default, typ in TYPED_PARAMS:
        v = F.coalesce(_first(source, f"(?md)^{key}{_WS}*={_WS}*{pat}"), F.lit(default))
        fields.append((v if typ == "string" else v.cast(typ)).alias(name))
    return F.struct(*fields)
