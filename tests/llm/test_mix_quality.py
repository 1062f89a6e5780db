"""Mixing and quality rules against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from marktext.llm.mixing import mix_decisions, mix_sources
from marktext.llm.quality import (base_failed, features, labelled_rates, learn_rules, quality_filter, quality_rules,
                                  text_statistics)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        above = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def corpus(n=3000):
    rows = []
    for i in range(n):
        source = None if i % 11 == 0 else ("hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else "tiny" if i < 40 else "s0")
        rows.append((i, " ".join(["w"] * ((i * 37) % 200)), source))
    return rows


def test_targets_and_taken_words(spark):
    rows = corpus()
    got = mix_decisions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes, size = defaultdict(int), {}
    for i, t, s in rows:
        size[i] = len(WORDS.findall(t))
        sizes[s] += size[i]
    target, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r["size"] == size[r["id"]] and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-12)
        rate = r["target"] / r["source_size"]
        if r["size"]:
            assert math.floor(rate) <= r["times"] <= math.ceil(rate) <= 3
        taken[r["source"]] += r["times"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) < 200, "within one document of the target"
    again = mix_decisions(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()
    assert {r["id"]: r["times"] for r in got} == {r["id"]: r["times"] for r in again}


def test_every_document_has_its_share_over_seeds(spark):
    rows = [(i, "w " * (1 + i % 5), "a" if i < 30 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    count, seeds = Counter(), 40
    for seed in range(seeds):
        for r in mix_decisions(df, seed=f"s{seed}").collect():
            count[r["id"]] += r["times"]
    want = brute_targets({"a": 90, "b": 90})
    for i in range(60):
        rate = want["a" if i < 30 else "b"] / 90
        assert abs(count[i] / seeds - rate) < 0.35


def test_mix_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", None), (3, "a b", None), (None, "a", "y"), (4, "a b c", "y"), (5, "q", "only")]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], SCHEMA + ", size double").selectExpr("*", "1 as id", "2 as _id", "3 as row", "4 as nth")
    got = mix_decisions(df).collect()
    assert sum(r["copies"] for r in got) == len(rows)
    mixed = mix_sources(df)
    assert mixed.columns == df.columns
    times = {(r["id"], r["source"], r["size"]): r["times"] for r in got}
    n = Counter((r["doc_id"], r["source"]) for r in mixed.collect())
    assert n[(3, None)] == 2 * times[(3, None, 2)] and n[(4, "y")] == times[(4, "y", 3)]
    assert mix_decisions(df.limit(0)).count() == 0 and mix_sources(df.limit(0)).count() == 0


def brute_statistics(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    n, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if n[x] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n \nx", "#a $b| <c> & d*",
         "éé 中文 \U0001f600 b", "a b c d a b c x a b c", "\n".join(["l one two"] * 300), "A\x0bB\x0cC\rD e"]


def test_statistics(spark):
    got = text_statistics(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_statistics(TEXTS[r["id"]])


def labelled_corpus(n=1200):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [f"w{(i * 31 + k * 17) % 997}" for k in range(60 + i % 30)]
        if bad:
            words = [w + "###" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "s"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_learned_rules_separate(spark):
    rows, labels = labelled_corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, (5, None, 0), (None, 0, 0), labels[0]], "doc_id long, quality int, toxic int")
    got = {r["id"]: r for r in quality_rules(docs, marks).collect()}
    assert all(got[i]["kept"] == (i % 5 != 0) for i in got)
    assert {r["rule"] for r in got.values()} >= {0, 1}
    kept = quality_filter(docs.withColumn("n_words", F.lit("clash")), marks)
    assert kept.columns == [*docs.columns, "n_words"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in got if got[i]["kept"])


def test_rules_are_precise_on_noise(spark):
    """Labels that no statistic explains give no rule, so clean documents stay."""
    rows, _ = labelled_corpus()
    rows = [(i, t.lower().replace("#", "").replace("!", ""), s) for i, t, s in rows]
    marks = spark.createDataFrame([(i, (i * 7919) % 13 % 2) for i in range(1200)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, SCHEMA)
    rules = learn_rules(labelled_rates(text_statistics(docs).cache(), marks, "doc_id", "quality"), list(features()))
    covered = sum(r["rule"] > 0 for r in quality_rules(docs, marks).collect())
    assert len(rules) <= 2 and covered < 120


def test_quality_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)] + [(3, "a", "s")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules(docs, none).collect()
    assert len(got) == len(TEXTS) + 1 and all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality_rules(docs.limit(0), none).count() == 0
    assert quality_filter(docs.limit(0), none).count() == 0
    failed = text_statistics(docs).where(base_failed()).count()
    assert failed == sum((s := brute_statistics(t))[0] < 50 or 100 * s[4] > 50 * s[0] for t in [*TEXTS, "a"])
