"""Smaller operators: S5, S9, K6, V8, O6, A21."""

from __future__ import annotations

import os

import numpy as np
from conftest import FATHA, KAF, KASRA, TA, marked
from pyspark.sql import functions as F

from marktext.operators import corpus as K
from marktext.operators import embed as E
from marktext.operators import validate as V
from marktext.sinks import writers as W
from marktext.sources import files as FS


def test_resolve_val_shard(spark):
    ids = spark.createDataFrame([("d1", 0), ("d1", 1), ("d1", 2)], "condition string, shard_id int")
    assert FS.resolve_val_shard(None, ids).first()["val_shard"] == 2
    man = spark.createDataFrame([("d1", 7)], "condition string, val_shard int")
    assert FS.resolve_val_shard(man, ids).first()["val_shard"] == 7


def test_vocab_roundtrip_and_atomic_map_file(spark, scratch):
    rows = [(0, bytearray(b"a"), 0, False), (1, bytearray(b"\xd8"), 1, False),
            (2, bytearray("ب".encode()), 2, False)]
    p = os.path.join(scratch, "vocab")
    spark.createDataFrame(rows, "token_id int, token binary, rank int, is_special boolean").write.parquet(p)
    v = {r["token_id"]: r["token_text"] for r in FS.scan_vocab(spark, p).collect()}
    assert v[0] == "a" and v[1] == "" and v[2] == "ب"
    mp = os.path.join(scratch, "map")
    W.write_atomic_map(K.atomic_map(spark), mp)
    back = spark.read.json(mp)
    assert back.count() == 621 and back.where("hex = '0xe000'").count() == 1


def test_baseline_checks(spark):
    b = spark.createDataFrame([("d1", 1.19), ("d2", 1.60), ("d3", 1.07)], "condition string, val_bpb double")
    f = spark.createDataFrame([("d1", 8192, 2.5), ("d3", 8192, 2.2)], "condition string, vocab_size int, fertility double")
    r = V.baseline_checks(b, f).first()
    assert r["d1_below_d2"] and r["d3_fertility_below_d1"]


def test_sample_rows_is_deterministic(spark):
    df = spark.range(1000).select(F.col("id").cast("int").alias("token_id"))
    a = [r[0] for r in E.sample_rows(df, 200, seed=42).collect()]
    b = [r[0] for r in E.sample_rows(df, 200, seed=42).collect()]
    assert a == b and len(set(a)) == 200
    assert E.sample_rows(df.limit(50), 200).count() == 50


def test_pair_token_cosine(spark):
    toks = [(0, marked(KAF, FATHA)), (1, marked(" ", KAF, KASRA)), (2, marked(TA, FATHA)), (3, "ab"),
            (4, marked(KAF, FATHA, TA))]
    vocab = spark.createDataFrame(toks, "token_id int, token_text string")
    rng = np.random.default_rng(1)
    emb = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(5)],
                                "vec_id long, embedding array<float>, label int")
    got = E.pair_token_cosine(vocab, emb).collect()
    assert len(got) == 1 and got[0]["base"] == marked(KAF) and got[0]["n_vectors"] == 2


def test_collision_reports(spark, mini_corpus):
    import json

    from marktext.operators import ambiguity as A
    pairs = A.word_pairs(mini_corpus)
    forms = A.surface_forms(pairs)
    summary = A.collision_summary(forms)
    top = A.top_forms(forms, 3)
    doc = W.collision_report_json(summary, top.select("rank", F.col("stripped").alias("word"), "n_variants"),
                                  A.form_variants(A.variant_counts(pairs), top)).first()["json"]
    got = json.loads(doc)
    s = summary.first()
    assert got["total_undiacritized_forms"] == s["total_undiacritized_forms"]
    assert got["context_window_tokens"] == 128 and len(got["top_50_ambiguous"]) == 3
    first = got["top_50_ambiguous"][0]
    assert first["variants"] == sorted(first["variants"])
    rate = A.window_ambiguity_sampled(mini_corpus, forms, window=2, n_samples=50)
    lines = W.collision_report_text(summary, A.top_ambiguous(pairs, k=20, n_shown=10), rate, 2).orderBy("line_no").collect()
    assert lines[0]["line"].startswith("Total unique undiacritized forms: ")
    assert lines[6]["line"].startswith("Context-window ambiguous token rate (2-tok): ")
    assert lines[8]["line"] == "Top 20 most ambiguous words:"


def test_json_report_keeps_its_lists_off_the_driver(spark, mini_corpus):
    """A scalar subquery's value is collected and becomes part of the plan: none may hold the variants."""
    from marktext.operators import ambiguity as A
    variants = A.variant_counts(A.word_pairs(mini_corpus))
    forms = A.forms_of(variants)

    def report(top):
        return W.collision_report_json(A.collision_summary(forms), top.select("rank", F.col("stripped").alias("word"), "n_variants"),
                                       A.form_variants(variants, top), window_rate=A.window_ambiguity_sampled(mini_corpus, forms, window=2, n_samples=50))
    plan = report(A.top_forms(forms, 3))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("collect_list" in line for line in plan)
    assert not [line for line in plan if line.startswith(":") and "collect_list" in line]     # below the root: its subqueries
    assert report(A.top_forms(forms, 3).where("rank < 0")).first()["json"].endswith(',"top_50_ambiguous":[]}')


def test_val_shard_missing_in_manifest_is_an_error(spark):
    import pytest
    man = spark.createDataFrame([("d1", None)], "condition string, val_shard int")
    with pytest.raises(Exception, match="no val_shard"):
        FS.resolve_val_shard(man, spark.createDataFrame([("d1", 0)], "condition string, shard_id int")).collect()


def test_search_logs_keep_file_and_line_order(spark, scratch):
    from marktext.operators import runs as R
    for name, rows in (("a.tsv", ["x\t1.5\t1\tkeep\tfirst", "", "y\t1.2\t1\tcrash\tno"]), ("b.tsv", ["z\t1.5\t2\tkeep\ttie"])):
        with open(os.path.join(scratch, name), "w") as f:
            f.write("commit\tval_bpb\tmemory_gb\tstatus\tdescription\n" + "\n".join(rows) + "\n")
    log = FS.scan_search_log(spark, scratch)
    assert [tuple(r["line_no"]) for r in log.orderBy("line_no").collect()] == [("a.tsv", 1), ("a.tsv", 3), ("b.tsv", 1)]
    assert R.best_kept(log).first()["commit"] == "x"


def test_errors_when_asked_for(spark):
    import pytest

    from marktext.functions import parse as P
    from marktext.operators import runs as R
    log = spark.createDataFrame([("a", 1.0, 1.0, "crash", "", 1)], "commit string, val_bpb double, memory_gb double, status string, description string, line_no int")
    assert R.best_kept(log).count() == 0
    with pytest.raises(Exception, match="no kept run"):
        R.best_kept(log, strict=True).collect()
    src = spark.createDataFrame([("nothing here",)], "source string")
    assert not any(r["found"] for r in P.extract_params(src).collect())
    with pytest.raises(Exception, match="missing parameter"):
        P.extract_params(src, strict=True).collect()


def test_baselines_need_every_key(spark):
    schema = "condition string, val_bpb double, depth int"
    f = spark.createDataFrame([("d1", 8192, 2.5), ("d3", 8192, 2.2)], "condition string, vocab_size int, fertility double")
    whole = [("d1", 1.1, 4), ("d2", 1.6, 4), ("d3", 1.0, 4)]
    assert V.baseline_checks(spark.createDataFrame(whole, schema), f).first()["keys_present"]
    for rows in (whole[:2], [*whole[:2], ("d3", 1.0, None)]):
        assert not V.baseline_checks(spark.createDataFrame(rows, schema), f).first()["keys_present"]


def test_corpus_of_several_files(spark, scratch):
    from marktext.sources import corpus as S
    rows = spark.createDataFrame([(i, "a", "a", "x", "y") for i in range(6)], S.CORPUS_SCHEMA)
    for k, split in enumerate(("train", "train", "val")):
        part = os.path.join(scratch, f"p{k}")
        rows.where(F.col("doc_id") % 3 == k).coalesce(1).write.parquet(part)
        src = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.makedirs(os.path.join(scratch, "all"), exist_ok=True)
        os.link(os.path.join(part, src), os.path.join(scratch, "all", f"{split}-{k}.parquet"))
    where = os.path.join(scratch, "all")
    assert S.scan_corpus(spark, where).count() == 6 and S.scan_corpus(spark, where, "train").count() == 4


def test_word_lookup_limits_and_token_matching(spark):
    from marktext.operators import ambiguity as A
    from marktext.operators import tokens as TK
    forms = spark.createDataFrame([(marked(KAF), 3)], "stripped string, n_variants long")
    words = spark.createDataFrame([(marked(KAF, FATHA),), (marked(TA),)], "word string")
    assert {r["word"]: r["n_variants"] for r in A.lookup_variant_counts(words, forms).collect()} == {marked(KAF, FATHA): 3, marked(TA): 0}
    docs = spark.range(5).withColumnRenamed("id", "ordinal")
    assert K.limit_examples(docs, 2).count() == 2 and K.limit_examples(docs, 0).count() == 5
    items = spark.createDataFrame([("ab",), ("c",)], "item string")
    vocab = spark.createDataFrame([("ab", 7)], "token_text string, token_id int")
    assert [tuple(r) for r in E.singleton_tokens(items, vocab, "item").collect()] == [("ab", 7)]
    assert [r[0] for r in E.skipped_items(items, vocab, "item").collect()] == ["c"]
    tok = lambda xs: spark.createDataFrame([(x,) for x in xs], "token string")
    loss = {r["token"]: r for r in TK.unigram_loss(tok("aab"), tok("abz")).collect()}
    assert abs(loss["a"]["loss_nats"] + np.log(3 / 6)) < 1e-12 and abs(loss["z"]["loss_nats"] + np.log(1 / 6)) < 1e-12


def test_null_groups_and_vectors(spark):
    rows = [(1, [1.0, 0.0], None), (2, [1.0, 0.0], None), (3, None, 1), (4, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["label"]: (r["n_vectors"], r["mean_cosine"]) for r in E.group_cosine(df).collect()}
    assert got == {None: (2, 1.0), 1: (1, None)}
    assert {r["label"]: r["cosine_to_rest"] for r in E.cosine_to_rest(df).collect()} == {None: 0.0, 1: 0.0}
