"""Publishing a corpus and reading it back; paged variant lists."""

from __future__ import annotations

import os

import pytest

from marktext.operators import ambiguity as A
from marktext.operators import corpus as K
from marktext.operators import validate as V
from marktext.sinks import publish as P
from marktext.sources import files as FS


def test_readers_follow_the_newest_version(spark, mini_corpus, scratch):
    root = os.path.join(scratch, "pub")
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, root)
    shards = K.build_conditions(mini_corpus, docs_per_shard=30)
    man = K.manifest(shards, docs_per_shard=30)
    first = P.publish_conditions(shards, man, root, docs_per_file=30)
    assert P.current_version(spark, root) == (1, first)
    back, read = P.read_published(spark, root)
    assert sorted(map(tuple, back.select("condition", "split", "shard_id", "ordinal", "doc_id", "text").collect())) == \
        sorted(map(tuple, shards.select("condition", "split", "shard_id", "ordinal", "doc_id", "text").collect()))
    val = FS.resolve_val_shard(read, back.select("condition", "shard_id"))
    checks = V.validate_all(V.shards_present(back, read), V.val_shard_holds(back, val)).collect()
    assert len(checks) == 9 and all(r["passed"] for r in checks)
    half = shards.where("doc_id % 2 = 0")
    second = P.publish_conditions(half, K.manifest(half, 30), root)
    assert P.current_version(spark, root) == (2, second)
    assert P.read_published(spark, root)[0].count() == half.count()


def test_a_document_meets_its_places_before_it_is_encoded(mini_corpus):
    """the join moves every source once, not each condition's text, and broadcasts no text."""
    made = K.build_conditions(mini_corpus, docs_per_shard=30)
    plan = made._jdf.queryExecution().executedPlan().toString()
    join, encoder = plan.index("SortMergeJoin [doc_id"), plan.index("ArrowEvalPython")
    assert encoder < join and plan.count("ArrowEvalPython") == 1  # the plan prints the last step first
    texts = K.condition_texts(mini_corpus).select("condition", "doc_id", "text", "letters", "split")
    index = K.condition_index(K.condition_keys(mini_corpus), docs_per_shard=30)
    want = texts.drop("split").join(index, ["condition", "doc_id"])
    cols = ["condition", "doc_id", "ordinal", "text", "split", "shard_id", "letters"]
    assert made.columns == cols
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_a_version_with_missing_rows_is_not_pointed_to(spark, mini_corpus, scratch):
    root = os.path.join(scratch, "wrong")
    shards = K.build_conditions(mini_corpus, docs_per_shard=30)
    with pytest.raises(ValueError, match="d2"):
        P.publish_conditions(shards.where("NOT (condition = 'd2' AND ordinal = 3)"), K.manifest(shards, 30), root)
    assert P.current_version(spark, root) == (0, None)


def test_missing_shards_fail(spark, mini_corpus):
    shards = K.build_conditions(mini_corpus, docs_per_shard=30)
    man = K.manifest(shards, docs_per_shard=30)
    rows = V.shards_present(shards.where("NOT (condition = 'd1' AND shard_id = 1)"), man).collect()
    assert {r["condition"]: r["passed"] for r in rows} == {"d1": False, "d2": True, "d3": True}


def test_pages_hold_all_variants_in_order(spark):
    pairs = [(1, i, f"v{i % 23:02d}", "form") for i in range(60)] + [(2, 0, "x", "other")]
    variants = A.variant_counts(spark.createDataFrame(pairs, "doc_id long, pos int, variant string, stripped string"))
    pages = A.variant_pages(variants, A.top_forms(A.forms_of(variants), 2), page_size=5).orderBy("rank", "page").collect()
    assert [(r["word"], r["page"], r["n_variants"]) for r in pages] == [("form", i, 5) for i in range(4)] + [("form", 4, 3), ("other", 0, 1)]
    assert " | ".join(r["variants"] for r in pages[:5]) == " | ".join(f"v{i:02d}" for i in range(23))
