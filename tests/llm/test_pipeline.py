"""Pipeline stages on a small corpus, each held against its operator's brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from conftest import SF_SMALL

import corpus_pipeline
from marktext.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect(), *out


def test_quality_keeps_clean_documents(spark, stages):
    source, kept = stages[0], {r["doc_id"] for r in stages[1]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    clean = [r["doc_id"] for r in source if labels.get(r["doc_id"]) == 1 and len(r["text"].split()) >= 50]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) >= 50 for r in stages[1])


def test_line_stage(stages):
    before, after = {r["doc_id"]: r["text"] for r in stages[1]}, stages[2]
    assert {r["doc_id"] for r in after} == set(before)
    seen, gone = set(), {}
    for i in sorted(before):
        lines = [(k, x) for k, x in enumerate(before[i].split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
        drop = set()
        for k in range(len(lines) - 2):
            w = tuple(x for _, x in lines[k:k + 3])
            if w in seen:
                drop |= {lines[k + j][0] for j in range(3)}
            seen.add(w)
        gone[i] = drop
    for r in after:
        assert r["text"] == "\n".join(x for k, x in enumerate(before[r["doc_id"]].split("\n")) if k not in gone[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])


def test_near_duplicate_stage(stages):
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in stages[2]}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in stages[3]) == sorted({find(i) for i in ids})


def test_mix_and_encode_stages(stages):
    assert set(stages[4]) <= set(stages[3])
    assert max(Counter(r["doc_id"] for r in stages[4]).values()) <= 3
    assert Counter(r["doc_id"] for r in stages[4]) == Counter(r["doc_id"] for r in stages[5])
    text = {r["doc_id"]: r["text"] for r in stages[4]}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in stages[5])


def test_run_and_registry(spark, stages):
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    got = names["pipeline"](spark, SF_SMALL).collect()
    assert sorted(map(str, got)) == sorted(map(str, stages[5]))
