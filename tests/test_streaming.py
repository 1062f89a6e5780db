"""Run-log stream: new log files become run records exactly once."""

from __future__ import annotations

import os

from marktext.streaming.run_logs import start_run_log_stream

LOG = "warmup\nval_bpb: {v}\ntotal_eval_nats: 1000.5\ntotal_valid_tokens: 400\nnum_steps: 12\n"


def test_stream_appends_new_runs_once(spark, scratch):
    logs, table, ck = (os.path.join(scratch, x) for x in ("logs", "runs", "ck"))
    os.makedirs(logs)
    for name, v in (("d1_5000000_s42.log", "1.50"), ("d3_5000000_s42.log", "1.70")):
        with open(os.path.join(logs, name), "w") as f:
            f.write(LOG.format(v=v))
    with open(os.path.join(logs, "d1_5000000_s137.log"), "w") as f:
        f.write("crashed before eval\n")                      # incomplete: dropped
    blpt = {"d1": 1.5, "d3": 1.7}
    start_run_log_stream(spark, logs, table, ck, blpt).awaitTermination()
    assert spark.read.parquet(table).count() == 2
    with open(os.path.join(logs, "d1_15000000_s42.log"), "w") as f:
        f.write(LOG.format(v="1.40"))
    start_run_log_stream(spark, logs, table, ck, blpt).awaitTermination()
    runs = spark.read.parquet(table)
    assert runs.count() == 3
    r = runs.where("condition = 'd1' AND target_base_letters = 15000000").first()
    assert r["actual_base_letters"] == round(12 * 32768 * 1.5, 1) and r["seed"] == 42
