"""Embedding structure: closed forms against pairwise brute force (numpy)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from marktext.operators import embed as E


def _pairwise_mean(vs):
    v = np.asarray(vs, dtype=np.float64)
    n = len(v)
    if n < 2:
        return None
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
    s = u @ u.T
    return float(s[~np.eye(n, dtype=bool)].mean())


def _table(spark):
    rng = np.random.default_rng(0)
    rows, vid = [], 0
    groups = {0: rng.normal(size=(6, 8)), 1: rng.normal(size=(1, 8)),          # group of one -> NULL
              2: np.vstack([rng.normal(size=(3, 8)), np.zeros((1, 8))]),         # zero vector
              3: np.tile(rng.normal(size=(1, 8)), (4, 1))}                       # identical -> 1
    for g, vs in groups.items():
        for v in vs:
            rows.append((vid, [float(x) for x in v.astype(np.float32)], g))
            vid += 1
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), groups


def test_group_cosine_closed_form(spark):
    df, groups = _table(spark)
    got = {r["label"]: r["mean_cosine"] for r in E.group_cosine(df, digits=None).collect()}
    for g, vs in groups.items():
        want = _pairwise_mean(vs.astype(np.float32))
        if want is None:
            assert got[g] is None
        else:
            assert abs(got[g] - want) < 1e-9
    assert abs(got[3] - 1.0) < 1e-9
    plan = E.group_cosine(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_overall_and_cross(spark):
    df, groups = _table(spark)
    ov = E.overall_cosine(E.group_cosine(df, digits=None), digits=None).first()
    means = [m for m in (_pairwise_mean(v.astype(np.float32)) for v in groups.values()) if m is not None]
    assert ov["n_groups"] == 3 and abs(ov["overall_mean"] - np.mean(means)) < 1e-9
    assert abs(ov["overall_std"] - np.std(means, ddof=1)) < 1e-9
    a, b = df.where("label = 0"), df.where("label = 2")
    ua = np.asarray(groups[0], dtype=np.float32).astype(np.float64)
    ub = np.asarray(groups[2], dtype=np.float32).astype(np.float64)
    ua = ua / np.maximum(np.linalg.norm(ua, axis=1, keepdims=True), 1e-10)
    ub = ub / np.maximum(np.linalg.norm(ub, axis=1, keepdims=True), 1e-10)
    got = E.cross_group_cosine(a, b).first()["cross_cosine"]
    assert abs(got - float((ua @ ub.T).mean())) < 1e-9


def test_frequency_and_pca(spark):
    df, groups = _table(spark)
    top = E.group_frequency(df, k=2).orderBy("rank").collect()
    assert [(r["label"], r["n"]) for r in top] == [(0, 6), (2, 4)]
    coords, ratios = E.pca_2d(df)
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], dtype=np.float64)
    xc = x - x.mean(axis=0)
    sv = np.linalg.svd(xc, compute_uv=False) ** 2
    assert np.allclose(ratios, (sv / sv.sum())[:2], atol=1e-6)
    assert coords.count() == len(x)


def test_letters_and_marks_of_a_vocabulary(spark):
    from conftest import BA, FATHA, KAF, KASRA, marked

    from marktext.functions import chars as C
    from marktext.operators import corpus as K
    m = C.atomic_mapping()
    toks = [m[marked(KAF, FATHA)], m[marked(KAF, KASRA)], m[marked(BA, FATHA)], marked(KAF), marked(BA), marked(FATHA), marked(KASRA), "zz"]
    vocab = spark.createDataFrame([(i, t, False) for i, t in enumerate(toks)], "token_id int, token_text string, is_special boolean")
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(8, 5)).astype(np.float32)
    emb = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, label int")
    got = {r["base"]: r for r in E.letter_cosine(K.atomic_map(spark), vocab, emb).collect()}
    assert got[marked(KAF)]["n_vectors"] == 2 and got[marked(BA)]["mean_cosine"] is None
    assert abs(got[marked(KAF)]["mean_cosine"] - _pairwise_mean(vecs[:2])) < 1e-8
    assert got[marked(BA)]["n_groups"] == 1 and got[marked(BA)]["overall_mean"] == got[marked(KAF)]["mean_cosine"]
    r = E.mark_letter_cosine(vocab, emb).first()
    u = vecs.astype(np.float64) / np.linalg.norm(vecs.astype(np.float64), axis=1, keepdims=True)
    assert (r["n_marks"], r["n_letters"]) == (2, 2)
    assert abs(r["cross"] - float((u[5:7] @ u[3:5].T).mean())) < 1e-8 and abs(r["marks"] - _pairwise_mean(vecs[5:7])) < 1e-8


def test_covariance_and_explained_variance_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>").repartition(4)
    cov = E.covariance(df)
    want = np.cov(x.T)
    assert all(abs(r["cov"] - want[r["i"], r["j"]]) < 1e-9 for r in cov.collect()) and cov.count() == 15
    got = E.explained_variance(cov).orderBy("axis").collect()
    values = np.linalg.eigvalsh(want)[::-1]
    assert np.allclose([r["variance"] for r in got], values) and abs(sum(r["share"] for r in got) - 1) < 1e-6
    _, ratios = E.pca_2d(df.where("embedding is not null").withColumn("label", F.lit(1)))
    assert np.allclose([r["share"] for r in got[:2]], ratios)
    assert [r["variance"] for r in E.explained_variance(E.covariance(df.limit(1))).collect()] == [None] * 5
    assert E.covariance(df.where("vec_id = 99")).count() == 0
