"""Run analytics, log parsing and file sources (F5-F7 style fixtures, our own values)."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import functions as F

from marktext.functions import parse as P
from marktext.operators import runs as R
from marktext.sources import files as FS


def _runs(spark):
    rows = [
        ("d1", 5_000_000, 1, 3.0), ("d1", 5_000_000, 2, 4.0), ("d1", 5_000_000, 3, 8.0),
        ("d3", 5_000_000, 1, 3.5),                                  # n = 1 -> std 0
        ("d1", 15_000_000, 1, 2.0), ("d1", 15_000_000, 2, 3.0),     # even n -> midpoint median
        ("d3", 15_000_000, 1, 2.5), ("d3", 15_000_000, 2, 2.5),     # tie for best seed
    ]
    return spark.createDataFrame(rows, "condition string, target_base_letters long, seed int, bpbl double") \
        .withColumn("actual_base_letters", F.col("target_base_letters") * 1.0)


def test_summary_grid_and_std(spark):
    s = {(r["condition"], r["target_base_letters"]): r
         for r in R.summary_by_budget(_runs(spark), budgets=(5_000_000, 15_000_000, 30_000_000)).collect()}
    assert len(s) == 6
    assert s[("d1", 5_000_000)]["mean_bpbl"] == 5.0 and abs(s[("d1", 5_000_000)]["std_bpbl"] - math.sqrt(7)) < 1e-6
    assert s[("d3", 5_000_000)]["std_bpbl"] == 0.0 and s[("d3", 5_000_000)]["n"] == 1
    assert s[("d1", 30_000_000)]["n"] == 0 and s[("d1", 30_000_000)]["mean_bpbl"] is None
    assert s[("d1", 30_000_000)]["budget_label"] == "30M"


def test_robust_stats_and_best_seed(spark):
    st = {(r["condition"], r["target_base_letters"]): r
          for r in R.robust_stats(_runs(spark), keys=("condition", "target_base_letters")).collect()}
    assert st[("d1", 15_000_000)]["median"] == 2.5
    assert st[("d1", 5_000_000)]["worst_seed"] == 3 and st[("d1", 5_000_000)]["best_seed"] == 1
    best = {r["condition"]: r["best_seed"] for r in R.best_seed(
        _runs(spark).where("target_base_letters = 15000000"), metric="bpbl").collect()}
    assert best["d3"] == 1


def test_gap_pending_union(spark):
    summ = R.summary_by_budget(_runs(spark), budgets=(5_000_000, 15_000_000, 30_000_000))
    gaps = {r["target_base_letters"]: r for r in R.gap_table(summ).collect()}
    assert gaps[5_000_000]["winner"] == "D3" and abs(gaps[5_000_000]["encoding_gap"] + 1.5) < 1e-9
    assert gaps[30_000_000]["winner"] == "N/A"
    pend = R.pending_runs(_runs(spark), budgets=(5_000_000,), seeds=(1, 2, 3))
    assert sorted((r["condition"], r["seed"]) for r in pend.collect()) == [("d3", 2), ("d3", 3)]
    u = R.union_runs(_runs(spark), R.relabel(_runs(spark), "d3_d1arch", "arch", "d1"))
    assert u.count() == 16 and "architecture" in u.columns


def test_formulas(spark):
    r = spark.range(1).select(
        R.bpbl(F.lit(100.0), F.lit(10), F.lit(2.0)).alias("b"),
        R.calibrate_steps(F.lit(5_000_000), F.lit(1.5)).alias("s"),
        R.actual_base_letters(F.lit(10), F.lit(1.5)).alias("a")).first()
    assert abs(r["b"] - 100 / (10 * 2 * math.log(2))) < 1e-12
    assert r["s"] == int(5_000_000 / (32768 * 1.5)) and r["a"] == 10 * 32768 * 1.5
    g = R.calibration_grid(spark, 11_333_000).where("condition = 'd1' AND budget = 5000000").first()
    blpw = 11_333_000 / 2_990_668
    assert abs(g["bl_per_token"] - blpw / 2.5189) < 1e-12


def test_parse_metrics_first_wins_missing_crlf(spark):
    logs = [
        "step 1\nval_bpb: 1.2345\nnum_steps: 100\nval_bpb: 9.9\ntotal_eval_bytes: 42\n",
        "val_bpb:   2.5\r\nnum_steps: 7\r\n",
    ]
    df = spark.createDataFrame([(l,) for l in logs], "log string").select(P.parse_metrics(F.col("log")).alias("m"))
    a, b = [r["m"] for r in df.collect()]
    assert a["val_bpb"] == 1.2345 and a["num_steps"] == 100 and a["total_eval_bytes"] == 42
    assert a["peak_vram_mb"] is None
    assert b["val_bpb"] is None and b["num_steps"] is None      # CRLF lines do not match


def test_extract_params(spark):
    src = "ASPECT_RATIO = 48\nWINDOW_PATTERN = \"SSL\"\nDEPTH=4  \r\nMATRIX_LR = 0.03\n"
    df = spark.createDataFrame([("abc", src)], "commit string, source string")
    kv = {r["key"]: (r["value"], r["found"]) for r in P.extract_params(df).collect()}
    assert kv["ASPECT_RATIO"] == ("48", True) and kv["DEPTH"] == ("4", True)
    assert kv["WINDOW_PATTERN"] == ('"SSL"', True) and kv["HEAD_DIM"] == (None, False)
    t = df.select(P.extract_params_typed(F.col("source")).alias("p")).first()["p"]
    assert t["ASPECT_RATIO"] == 48 and t["HEAD_DIM"] == 96 and t["WINDOW_PATTERN"] == "SSL"
    assert t["DEPTH"] == 4 and t["MATRIX_LR"] == 0.03 and t["ADAM_BETAS"] == "(0.8, 0.95)"


def test_search_log(spark, scratch):
    from marktext.operators.validate import search_log_gate
    path = os.path.join(scratch, "log.tsv")
    with open(path, "w") as f:
        f.write("commit\tval_bpb\tmemory_gb\tstatus\tdescription\n")
        f.write("a1\t1.20\t10.0\tkeep\tbase\n\n")
        f.write("a2\t0.00\t0.0\tcrash\tboom\n")
        f.write("a3\t1.10\t11.0\tkeep\tbetter\n")
        f.write("a4\t1.10\t11.0\tkeep\tsame\n")
        f.write("a5\t0\t0\tkeep\tzero\n")
    log = FS.scan_search_log(spark, path)
    assert log.count() == 5
    best = R.best_kept(log).first()
    assert best["commit"] == "a3"
    c = R.search_counts(log).first()
    assert (c["total_experiments"], c["keep_count"], c["crash_count"]) == (5, 4, 1)
    g = search_log_gate(log, baseline_bpb=1.15, min_rows=3).first()
    assert g["enough_rows"] and g["has_columns"] and g["beats_baseline"]
    assert R.best_kept(log.where("status <> 'keep'")).count() == 0


def test_scan_runs_and_seed_results(spark, scratch):
    runs = {"runs": [{"condition": "d1", "target_base_letters": 5000000, "seed": 42, "bpbl": 4.1,
                      "val_bpb": 1.1, "total_eval_nats": 10.0, "total_valid_tokens": 5, "num_steps": 3},
                     {"condition": "d3", "target_base_letters": 5000000, "seed": 42, "bpbl": 4.9,
                      "val_bpb": 1.3, "total_eval_nats": 11.0, "total_valid_tokens": 5}]}
    p = os.path.join(scratch, "runs.json")
    with open(p, "w") as f:
        json.dump(runs, f, indent=2)
    df = FS.scan_runs(spark, p)
    assert df.count() == 2 and R.complete_runs(df).count() == 1
    assert R.complete_runs(df, need_steps=False).count() == 2
    sp = os.path.join(scratch, "seeds.json")
    with open(sp, "w") as f:
        json.dump({"d1": {"all_seeds": [1, 2, 3], "all_bpbl": [2.0, 3.0, 2.5], "val_bpb": [0.1, 0.2, 0.3]}}, f)
    s = FS.scan_seed_results(spark, sp)
    assert sorted((r["seed"], r["bpbl"]) for r in s.collect()) == [(1, 2.0), (2, 3.0), (3, 2.5)]


def test_training_logs(spark, scratch):
    d = os.path.join(scratch, "logs")
    os.makedirs(d)
    with open(os.path.join(d, "run1.log"), "w") as f:
        f.write("hello\nval_bpb: 1.5\ntotal_eval_nats: 12.5\ntotal_valid_tokens: 10\nnum_steps: 3\n")
    got = FS.scan_training_logs(spark, d).first()
    assert got["file_name"] == "run1.log" and got["val_bpb"] == 1.5 and got["num_steps"] == 3.0


def test_whole_budget_takes_every_train_letter(spark):
    rows = [("d1", "train" if i % 5 else "val", i, "ab" * (i % 7 + 1), 2 * (i % 7 + 1)) for i in range(60)]
    rows += [("d3", *r[1:]) for r in rows]
    shards = spark.createDataFrame(rows, "condition string, split string, doc_id long, text string, letters long")
    total = sum(r[4] for r in rows if r[0] == "d1" and r[1] == "train")
    runs = R.corpus_runs(shards, budgets=(10, 50), whole=True).collect()
    assert {r["target_base_letters"] for r in runs} == {10, 50, total} and len(runs) == 18
    assert all(r["actual_base_letters"] == total and r["num_steps"] == 48 for r in runs if r["target_base_letters"] == total)
    assert all(r["target_base_letters"] <= r["actual_base_letters"] for r in runs)
    df = spark.createDataFrame(runs)
    assert R.pending_runs(df, budgets=None, seeds=(*R.SEEDS, 7)).count() == 6
    assert R.summary_by_budget(df, budgets=None).where("n = 3").count() == 6
