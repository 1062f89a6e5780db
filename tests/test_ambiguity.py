"""Homograph ambiguity (J1, A1-A6) against plain-Python definitions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from conftest import FATHA, KAF, KASRA, TA, marked
from pyspark.sql import functions as F

from marktext.functions import chars as C
from marktext.operators import ambiguity as A

STRIP = {ord(m): None for m in C.MARKS}


def py_forms(rows, align="zip"):
    forms, total = defaultdict(set), 0
    for voc, non in rows:
        if align == "zip":
            for vw, nw in zip(voc.split(), non.split()):
                forms[nw].add(vw)
                total += 1
        else:
            for vw in voc.split():
                forms[vw.translate(STRIP)].add(vw)
                total += 1
    return forms, total


def test_collision_summary_matches_python(mini_corpus):
    rows = [(r["vocalized"], r["non_vocalized"]) for r in mini_corpus.collect()]
    for align in ("zip", "strip"):
        forms, total = py_forms(rows, align)
        got = A.collision_summary(A.surface_forms(A.word_pairs(mini_corpus, align=align))).first()
        counts = [len(v) for v in forms.values()]
        assert got["total_undiacritized_forms"] == len(forms)
        assert got["total_diacritized_forms"] == sum(counts)
        assert got["ambiguous_form_count"] == sum(1 for c in counts if c > 1)
        assert got["max_collision_rate"] == max(counts)
        assert got["total_words_analyzed"] == total
        assert abs(got["avg_collision_rate"] - sum(counts) / len(counts)) < 1e-12


def test_zip_drift_with_marks_only_word(spark):
    # The marks-only word vanishes from the stripped side: zip pairs later words wrongly.
    voc = marked(KAF, FATHA, " ", FATHA, " ", TA, KASRA)
    non = voc.translate(STRIP)
    df = spark.createDataFrame([(0, voc, non)], "doc_id long, vocalized string, non_vocalized string")
    pairs = {(r["variant"], r["stripped"]) for r in A.word_pairs(df).collect()}
    assert (marked(FATHA), marked(TA)) in pairs and len(pairs) == 2
    strip_pairs = {(r["variant"], r["stripped"]) for r in A.word_pairs(df, align="strip").collect()}
    assert (marked(FATHA), "") in strip_pairs and len(strip_pairs) == 3


def test_top_ambiguous_ties_by_first_appearance(mini_corpus):
    rows = [(r["doc_id"], r["vocalized"], r["non_vocalized"]) for r in mini_corpus.orderBy("doc_id").collect()]
    forms, first = defaultdict(set), {}
    for d, voc, non in rows:
        for p, (vw, nw) in enumerate(zip(voc.split(), non.split())):
            forms[nw].add(vw)
            first.setdefault(nw, (d, p))
    expect = sorted(forms.items(), key=lambda kv: (-len(kv[1]), first[kv[0]]))[:5]
    got = A.top_ambiguous(A.word_pairs(mini_corpus), k=5, n_shown=2).orderBy("rank").collect()
    assert [r["word"] for r in got] == [w for w, _ in expect]
    assert [r["top_variants"] for r in got] == [" | ".join(sorted(v)[:2]) for _, v in expect]


def test_window_rate_all_and_none_ambiguous(spark):
    # three words with two variants each -> 1.0; one variant each -> 0.0.
    words = [marked(KAF, FATHA), marked(TA, KASRA), marked(KAF, KASRA, TA)]
    alt = [marked(KAF, KASRA), marked(TA, FATHA), marked(KAF, FATHA, TA)]
    doc = " ".join(words[i % 3] for i in range(600))
    corpus = spark.createDataFrame([(0, doc, doc.translate(STRIP))],
                                   "doc_id long, vocalized string, non_vocalized string")
    two = spark.createDataFrame([(w.translate(STRIP), 2) for w in words], "stripped string, n_variants long")
    one = spark.createDataFrame([(w.translate(STRIP), 1) for w in alt], "stripped string, n_variants long")
    for forms, want in ((two, 1.0), (one, 0.0)):
        s = A.window_ambiguity_sampled(corpus, forms, window=10, n_samples=100, seed=42).first()
        e = A.window_ambiguity_exact(corpus, forms, window=10).first()
        assert s["rate"] == want and e["rate"] == want and s["windows"] == 100


def test_exact_window_weights_match_enumeration(spark):
    rng = random.Random(7)
    vocab = [marked(KAF, FATHA), marked(KAF, KASRA), marked(TA, FATHA), marked(TA)]
    docs = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 25))) for _ in range(12)]
    corpus = spark.createDataFrame([(i, d, d.translate(STRIP)) for i, d in enumerate(docs)],
                                   "doc_id long, vocalized string, non_vocalized string")
    forms = A.surface_forms(A.word_pairs(corpus))
    amb = {r["stripped"] for r in forms.where("n_variants > 1").collect()}
    w = 5
    rates = []
    for d in docs:
        ws = d.split()
        if len(ws) < w:
            continue
        per = [sum(x.translate(STRIP) in amb for x in ws[s:s + w]) / w for s in range(len(ws) - w + 1)]
        rates.append(sum(per) / len(per))
    want = sum(rates) / len(rates)
    got = A.window_ambiguity_exact(corpus, forms, window=w).first()["rate"]
    assert abs(got - want) < 1e-9


def test_char_distribution_matches_counter(mini_corpus):
    rows = mini_corpus.orderBy("doc_id").select("doc_id", F.col("vocalized").alias("text")).collect()
    cnt, first = Counter(), {}
    for r in rows:
        cnt.update(r["text"])
        for p, ch in enumerate(r["text"]):
            first.setdefault(ch, (r["doc_id"], p))
    expect = sorted(cnt.items(), key=lambda kv: (-kv[1], first[kv[0]]))[:8]
    got = A.char_distribution(mini_corpus.select("doc_id", F.col("vocalized").alias("text")), k=8).orderBy("rank")
    assert [(r["ch"], r["n"]) for r in got.collect()] == expect


def test_sampled_windows_ignore_gaps_in_ids(spark, mini_corpus):
    """A4 draws by rank: ids with gaps give the same windows as dense ones."""
    gapped = mini_corpus.withColumn("doc_id", F.col("doc_id") * 1000 + 7)
    forms = A.surface_forms(A.word_pairs(mini_corpus))
    one = A.window_ambiguity_sampled(mini_corpus, forms, window=2, n_samples=1000).first()
    two = A.window_ambiguity_sampled(gapped, forms, window=2, n_samples=1000).first()
    assert one == two and one["windows"] == 1000


def test_character_counts_with_first_places(spark):
    rnd = random.Random(2)
    rows = [(i * 7 % 100, rnd.choice(["a", None, "b"]), rnd.choice([None, "", "".join(rnd.choice("xyz \U0001f600ب") for _ in range(9))]))
            for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, part string, text string").repartition(3)
    for ordinal in ("doc_id", None):
        got = {(r["part"], r["ch"]): (r["n"], r["first_ord"], r["first_pos"])
               for r in A.char_counts(df, group_cols=("part",), ordinal=ordinal).collect()}
        total, first = Counter(), {}
        for i, part, text in sorted(rows, key=lambda r: r[0]):
            for at, ch in enumerate(text or ""):
                total[part, ch] += 1
                first.setdefault((part, ch), (i, at) if ordinal else (None, None))
        assert got == {k: (n, *first[k]) for k, n in total.items()}
    whole = {r["ch"]: r["n"] for r in A.char_counts(df).collect()}
    assert whole == Counter("".join(t or "" for _, _, t in rows))
    assert A.char_counts(df.limit(0), group_cols=("part",), ordinal="doc_id").count() == 0


def test_first_places_need_no_sort(spark):
    """The minimum of a (doc_id, pos) struct had every word sorted before its first aggregation."""
    ids = [-(1 << 63), -5, -1, 0, (1 << 63) - 1]
    pairs = spark.createDataFrame([(i, p, "v", f"s{k}") for k, i in enumerate(ids) for p in (7, 3, (1 << 31) - 1)],
                                  "doc_id long, pos int, variant string, stripped string")
    for forms in (A.surface_forms(pairs), A.forms_of(A.variant_counts(pairs))):
        assert sorted((r["first_doc"], r["first_pos"]) for r in forms.collect()) == [(i, 3) for i in ids]
        assert [f.dataType.simpleString() for f in forms.schema.fields[3:]] == ["bigint", "int"]
        assert "SortAggregate" not in forms._jdf.queryExecution().executedPlan().toString()
