"""Data-quality checks (V1-V9).  Each returns rows ``(condition, check, passed, detail)``
so checks of every condition run to the end and are rolled up once (V6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import ambiguity as A

CHECK_SCHEMA = "condition string, check string, passed boolean, detail string"


def _row(df: DataFrame, check: str, passed, detail) -> DataFrame:
    return df.select("condition", F.lit(check).alias("check"), passed.alias("passed"),
                     detail.cast("string").alias("detail"))


def shards_loadable(shards: DataFrame) -> DataFrame:
    """V1: at least one file per condition, and every file readable (the scan succeeds)."""
    files = shards.select("condition", F.col("_metadata.file_path").alias("f"))
    agg = files.groupBy("condition").agg(F.count_distinct("f").alias("n_files"))
    return _row(agg, "shards_loadable", F.col("n_files") > 0, F.col("n_files"))


def shards_present(shards: DataFrame, manifest: DataFrame) -> DataFrame:
    """V1 against the manifest: as many shards can be read as it names (the train shards and one)."""
    got = shards.select("condition", "split", "shard_id").distinct().groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return _row(manifest.join(got, "condition", "left"), "shards_present", n == F.col("train_shards") + 1, n)


def val_shard_holds(shards: DataFrame, val: DataFrame) -> DataFrame:
    """All val rows, and no others, lie in the shard ``val (condition, val_shard)`` names."""
    j = shards.select("condition", "split", "shard_id").join(F.broadcast(val), "condition")
    agg = j.groupBy("condition", "val_shard").agg(
        F.bool_and((F.col("split") == "val") == (F.col("shard_id") == F.col("val_shard"))).alias("ok"))
    return _row(agg, "val_shard_holds", F.col("ok"), F.col("val_shard"))


def row_count_matches(shards: DataFrame, manifest: DataFrame) -> DataFrame:
    """V2: train / val row counts equal the manifest's."""
    got = shards.groupBy("condition").agg(F.count_if(F.col("split") == "train").alias("tr"),
                                          F.count_if(F.col("split") == "val").alias("va"))
    j = manifest.join(got, "condition", "left")
    tr, va = F.coalesce("tr", F.lit(0)), F.coalesce("va", F.lit(0))
    ok = (tr == F.col("train_docs")) & (va == F.col("val_docs"))
    return _row(j, "row_count_matches", ok, F.format_string("%d train, %d val", tr, va))


def no_empty_texts(shards: DataFrame) -> DataFrame:
    """V3: no NULL or '' text (whitespace-only passes here, unlike the build filter)."""
    agg = shards.groupBy("condition").agg(
        F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("bad"))
    return _row(agg, "no_empty_texts", F.col("bad") == 0, F.col("bad"))


def mapping_gate(shards: DataFrame, mapping: DataFrame, minimum: int = 252) -> DataFrame:
    """V5: d3 only — the atomic mapping has at least ``minimum`` entries."""
    n = mapping.select(F.count(F.lit(1))).scalar()
    d3 = shards.where(F.col("condition") == "d3").select("condition").distinct()
    return _row(d3, "mapping_gate", n >= minimum, n)


def mark_presence(shards: DataFrame) -> DataFrame:
    """V9: d1 has a mark, d2 has none, d3 has a private-use unit."""
    agg = shards.groupBy("condition").agg(F.bool_or(X.has_mark("text")).alias("marks"),
                                          F.bool_or(X.has_pua("text")).alias("pua"))
    c = F.col("condition")
    ok = (F.when(c == "d1", F.col("marks")).when(c == "d2", ~F.col("marks"))
          .when(c == "d3", F.col("pua")).otherwise(F.lit(True)))
    return _row(agg, "mark_presence", ok, F.format_string("marks=%s pua=%s", "marks", "pua"))


def char_distribution_check(shards: DataFrame, k: int = 20) -> DataFrame:
    """V4: informational top-k characters; always passes; detail lists codepoints."""
    top = A.char_distribution(shards, k, "text", "doc_id", ("condition",))
    agg = top.groupBy("condition").agg(F.sort_array(F.collect_list(F.struct("rank", "codepoint"))).alias("t"))
    return _row(agg, "char_distribution", F.lit(True),
                F.array_join(F.transform("t", lambda x: F.format_string("U+%04X", x["codepoint"])), " "))


def content_checks(texts: DataFrame, manifest: DataFrame, mapping: DataFrame, minimum: int = 252) -> DataFrame:
    """V2, V3, V5 and V9 over ``texts (condition, split, text)`` in one aggregation, unpivoted."""
    agg = texts.groupBy("condition").agg(
        F.count_if(F.col("split") == "train").alias("tr"), F.count_if(F.col("split") == "val").alias("va"),
        F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("bad"),
        F.bool_or(X.has_mark("text")).alias("marks"), F.bool_or(X.has_pua("text")).alias("pua"))
    c = F.col("condition")
    # The manifest has one row per condition.
    j = F.broadcast(manifest.select("condition", "train_docs", "val_docs")).join(agg, "condition", "left")
    n = mapping.select(F.count(F.lit(1))).scalar()
    tr, va = F.coalesce("tr", F.lit(0)), F.coalesce("va", F.lit(0))
    present = (F.when(c == "d1", F.col("marks")).when(c == "d2", ~F.col("marks")).when(c == "d3", F.col("pua"))
               .otherwise(F.lit(True)))

    def row(check, passed, detail):
        return F.struct(F.lit(check).alias("check"), passed.alias("passed"), detail.cast("string").alias("detail"))

    rows = F.array(
        row("row_count_matches", (tr == F.col("train_docs")) & (va == F.col("val_docs")), F.format_string("%d train, %d val", tr, va)),
        row("no_empty_texts", F.col("bad") == 0, F.col("bad")),
        row("mark_presence", present, F.format_string("marks=%s pua=%s", "marks", "pua")))
    gate = F.when(c == "d3", F.array(row("mapping_gate", n >= minimum, n))).otherwise(F.array().cast(
        "array<struct<check:string,passed:boolean,detail:string>>"))
    return j.select("condition", F.explode(F.concat(rows, gate)).alias("r")).select("condition", "r.*")


def validate_all(*checks: DataFrame) -> DataFrame:
    """V6: all check rows plus one roll-up row per condition (``passed n/m`` detail)."""
    rows = checks[0]
    for c in checks[1:]:
        rows = rows.unionByName(c)
    roll = rows.groupBy("condition").agg(
        F.bool_and("passed").alias("passed"),
        F.format_string("%d/%d", F.count_if("passed"), F.count(F.lit(1))).alias("detail"))
    return rows.unionByName(roll.select("condition", F.lit("all").alias("check"), "passed", "detail"))


def search_log_gate(log: DataFrame, baseline_bpb: float, min_rows: int = 70) -> DataFrame:
    """V7: enough rows, required columns present, and a kept run beating ``baseline_bpb``."""
    required = {"commit", "val_bpb", "memory_gb", "status", "description"}
    has_cols = required.issubset(set(log.columns))
    agg = log.agg(F.count(F.lit(1)).alias("n"),
                  F.bool_or((F.col("status") == "keep") & (F.col("val_bpb").cast("double") > 0)
                            & (F.col("val_bpb").cast("double") < baseline_bpb)).alias("beats"))
    return agg.select((F.col("n") >= min_rows).alias("enough_rows"), F.lit(has_cols).alias("has_columns"),
                      F.coalesce("beats", F.lit(False)).alias("beats_baseline"), F.col("n").alias("rows"))


def baseline_checks(baselines: DataFrame, fertility: DataFrame) -> DataFrame:
    """V8: every condition has all its keys; D1 val_bpb < D2 val_bpb; D3 fertility < D1 fertility
    (same vocab size)."""
    complete = F.count_distinct(F.when(F.least(*[F.col(c).isNotNull().cast("int") for c in baselines.columns]) == 1,
                                       F.col("condition")))
    keys_present = baselines.where(F.col("condition").isin("d1", "d2", "d3")).select(complete == 3).scalar()
    b = baselines.groupBy().pivot("condition", ["d1", "d2", "d3"]).agg(F.first("val_bpb"))
    f = fertility.groupBy("vocab_size").pivot("condition", ["d1", "d3"]).agg(F.first("fertility"))
    d1_below_d2 = b.select(F.col("d1") < F.col("d2")).scalar()
    return f.select("vocab_size", keys_present.alias("keys_present"), d1_below_d2.alias("d1_below_d2"),
                    (F.col("d3") < F.col("d1")).alias("d3_fertility_below_d1"))
