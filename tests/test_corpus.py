"""Corpus build: conditions, ordinals, split, shards, manifest, sinks and validation."""

from __future__ import annotations

import os
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from marktext.operators import corpus as K
from marktext.operators import validate as V
from marktext.sinks import writers as W
from marktext.sources import files as FS


def test_dense_ordinal_matches_row_number(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10**9), 3000)
    df = spark.createDataFrame([(i, "c%d" % (i % 3)) for i in ids], "doc_id long, grp string")
    got = K.dense_ordinal(df, "doc_id", partition_cols=("grp",))
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("grp").orderBy("doc_id")) - 1)
    bad = got.join(want, ["doc_id", "grp"]).where(F.col("ordinal") != F.col("w")).count()
    assert bad == 0 and got.count() == 3000


def test_ordinals_of_hashed_and_text_keys_spread(spark):
    """Sparse ids are ranked like dense ones, over several partitions."""
    df = spark.range(20_000).select(F.xxhash64("id").alias("doc_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tables this small would be one
    try:
        got = K.dense_ordinal(df).cache()
        got.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.agg(F.count_distinct("ordinal"), F.max("ordinal")).first()[:] == (20_000, 19_999)
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 20_000
    words = spark.createDataFrame([(f"k{i % 7}{i}",) for i in range(50)], "doc_id string")
    assert [r["doc_id"] for r in K.dense_ordinal(words).orderBy("ordinal").collect()] == sorted(r[0] for r in words.collect())


def test_index_and_texts_agree_without_shuffling_texts(mini_corpus):
    index = K.condition_index(K.condition_keys(mini_corpus), ratio=0.1)
    texts = K.condition_texts(mini_corpus, ratio=0.1)
    keys = ["condition", "doc_id", "split"]
    assert index.select(keys).exceptAll(texts.select(keys)).count() == 0 and texts.count() == index.count()
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    heavy = plan[plan.index("ArrowEvalPython"):]
    assert "hashpartitioning" not in plan[:plan.index("ArrowEvalPython")] or "hashpartitioning" not in heavy
    assert "Python" not in index._jdf.queryExecution().executedPlan().toString()


def test_split_sizes_follow_truncation(spark):
    for n, n_val in ((99, 1), (150, 3), (1, 1), (1000, 20)):
        df = spark.range(n).select(F.lit("d1").alias("condition"), F.col("id").alias("doc_id"),
                                   F.lit("x").alias("text"))
        m = K.manifest(K.split_and_shard(df, docs_per_shard=40), docs_per_shard=40).first()
        assert m["val_docs"] == n_val and m["train_docs"] == n - n_val
        assert m["train_shards"] == -(-(n - n_val) // 40) and m["val_shard"] == m["train_shards"]


def test_conditions_filter_separately(mini_corpus):
    shards = K.build_conditions(mini_corpus)
    per = {r["condition"]: r["count"] for r in shards.groupBy("condition").count().collect()}
    # One sentence holds a marks-only word but no sentence is marks-only: all 100 survive.
    assert per == {"d1": 100, "d2": 100, "d3": 100}
    one = K.build_condition(mini_corpus, "d3").select("doc_id", "ordinal", "split", "shard_id")
    both = shards.where("condition = 'd3'").select("doc_id", "ordinal", "split", "shard_id")
    assert one.exceptAll(both).count() == 0


def test_write_read_validate_shards(spark, mini_corpus, scratch):
    shards = K.build_conditions(mini_corpus, docs_per_shard=30)
    root = os.path.join(scratch, "shards")
    W.write_shards(shards, root)
    back = FS.scan_condition(spark, root)
    assert back.count() == 300
    val_d2 = FS.scan_condition(spark, root, "d2", "val")
    assert val_d2.count() == 2 and "PartitionFilters" in val_d2._jdf.queryExecution().executedPlan().toString()
    man = K.manifest(shards, docs_per_shard=30)
    W.write_manifest(man, os.path.join(scratch, "manifest"))
    parsed = FS.scan_manifest(spark, os.path.join(scratch, "manifest"))
    assert sorted((r["condition"], r["train_docs"], r["val_docs"], r["val_shard"]) for r in parsed.collect()) == \
        sorted((r["condition"], r["train_docs"], r["val_docs"], r["val_shard"]) for r in man.collect())
    checks = V.validate_all(V.shards_loadable(back), V.row_count_matches(back, man), V.no_empty_texts(back),
                            V.mark_presence(back), V.mapping_gate(back, K.atomic_map(spark)))
    rows = {(r["condition"], r["check"]): r["passed"] for r in checks.collect()}
    assert all(rows.values()) and rows[("d3", "all")]
    assert [r for r in checks.collect() if r["condition"] == "d1" and r["check"] == "all"][0]["detail"] == "4/4"


def test_upsert_report_replaces_keys(spark):
    old = spark.createDataFrame([("d1", 1.0), ("d2", 2.0)], "condition string, v double")
    new = spark.createDataFrame([("d2", 5.0), ("d3", 3.0)], "condition string, v double")
    got = sorted(tuple(r) for r in W.upsert_report(old, new, ["condition"]).collect())
    assert got == [("d1", 1.0), ("d2", 5.0), ("d3", 3.0)]


def test_atomic_map_dimension(spark):
    m = K.atomic_map(spark)
    assert m.count() == 621 and m.where("base IS NULL").count() == 9


def test_batches_of_texts_are_bounded(spark):
    """10,000 whole texts in one Arrow batch took an executor's memory."""
    from marktext.session import ARROW_ROWS
    from marktext.sources import corpus as S
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", ARROW_ROWS), ("0", ARROW_ROWS), ("100", 100)):
            spark.conf.set(key, given)
            S.lifted_corpus(spark, "/root/testdata/sf0.001")
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)


def test_source_expression_is_made_once(spark):
    """Filters on the lifted text were pushed below it, and every term of them lifted the text again."""
    from marktext.sources import corpus as S
    lifted = S.lifted_corpus(spark, "/root/testdata/sf0.001")
    for made in (K.condition_keys(lifted), K.condition_texts(lifted)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("translate(lower(") == 1


def test_one_split_is_the_same_rows_and_others_are_not_encoded(spark, mini_corpus):
    whole = K.condition_texts(mini_corpus)
    for split in ("train", "val"):
        assert sorted(K.condition_texts(mini_corpus, split=split).collect()) == sorted(whole.where(F.col("split") == split).collect())
    plan = K.condition_texts(mini_corpus, split="val")._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" in plan[plan.index("ArrowEvalPython"):] and ">= Subquery" in plan[plan.index("ArrowEvalPython"):].replace("scalar-subquery", "Subquery").replace("subquery#", "Subquery#")


def test_blank_documents_belong_to_no_condition(spark):
    rows = [(0, None), (1, ""), (2, " \t\u00a0"), (3, "\u064e \u0651"), (4, "a\u064e"), (5, "b"), (6, "\u3000x")]
    docs = spark.createDataFrame(rows, "doc_id long, vocalized string")
    kept = sorted((r["condition"], r["doc_id"]) for r in K.condition_keys(docs).collect())
    assert kept == sorted([(c, i) for c in ("d1", "d3") for i in (3, 4, 5, 6)] + [("d2", i) for i in (4, 5, 6)])
    assert sorted((r["condition"], r["doc_id"]) for r in K.condition_texts(docs).collect()) == kept


def test_keys_of_the_texts_run_no_encoder(mini_corpus):
    """the run queries keep (condition, split, doc_id, letters) apart; that must not encode the corpus."""
    texts = K.condition_texts(mini_corpus)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan(texts.select("condition", "split", "doc_id", "letters"))
    assert plan(texts).count("ArrowEvalPython") == 1
    for c in K.CONDITIONS:  # the fan-out changes no text
        want = {(r["doc_id"], r["text"]) for r in K.apply_condition(mini_corpus, c).collect()}
        assert {(r["doc_id"], r["text"]) for r in texts.where(F.col("condition") == c).collect()} == want and want
