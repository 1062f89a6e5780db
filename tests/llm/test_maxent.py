"""The maximum-entropy model: exact base scores, normalised probabilities, held-out gain."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marktext.llm import maxent_lm as M


def corpus(n=400):
    """Two invented languages; the word before tells which one the next word is from."""
    rnd = random.Random(4)
    words = [[f"{p}{a}{b}" for a in "aeiou" for b in "xyz"] for p in ("k", "m")]
    weights = [1 / (1 + i) for i in range(15)]
    return [(i, " ".join(rnd.choices(words[i % 2], weights, k=20 + i % 40) + [f"rare{i % 37}"])) for i in range(n)]


def in_training():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2


@pytest.fixture()
def small(monkeypatch):
    # Only what the driver decides by: Python workers import the module anew.
    for name, value in {"LOOKUP": 40, "UNITS": 25, "GROUPS": 4, "CLASSES": 8}.items():
        monkeypatch.setattr(M, name, value)


def scored(spark, rows, train=None):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["id"]: r for r in M.maxent_scores(df, in_training() if train is None else train).collect()}


def test_base_scores_and_held_out_gain(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, "NEVER seen words"), (1003, "É é kax KAX")]
    got = scored(spark, rows)
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    held = {i for i in words if zlib.crc32(str(i).encode()) % 7 == 2}
    c, docs = Counter(w for i in words if i not in held for w in words[i]), len(words) - len(held)
    n, v = sum(c.values()) + docs, len(c) + 1
    for i, ws in words.items():
        base = sum(math.log10((k + 1) / (n + v + 1)) for k in [*(c[w] for w in ws), docs])
        assert math.isclose(got[i]["base_score"], base, abs_tol=1e-9)
        assert (got[i]["n_tokens"], got[i]["train_tokens"]) == (len(ws) + 1, n)
        assert got[i]["n_known"] == sum(w in c for w in ws) + 1 and got[i]["train"] == (i not in held)
        assert got[i]["score"] < 0
    gain = [got[i]["score"] - got[i]["base_score"] for i in held if i < 1000]
    assert sum(gain) / sum(got[i]["n_tokens"] for i in held if i < 1000) > 0.1


def test_small_tables_use_every_path(spark, small):
    """Limits so small that units, looked-up words and rare words all occur."""
    rows = corpus()
    got = scored(spark, rows)
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split())
    docs = sum(r["train"] for r in got.values())
    n, v = sum(c.values()) + docs, len(c) + 1
    for i, t in rows:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t.split()) + math.log10((docs + 1) / (n + v + 1))
        assert math.isclose(got[i]["base_score"], base, abs_tol=1e-9)


def test_held_out_gain_does_not_depend_on_partitions(spark):
    rows, gain = corpus(), {}
    for k in (3, 30, 300):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(k)
        held = [r for r in M.maxent_scores(df, in_training()).collect() if not r["train"]]
        gain[k] = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    print(gain)
    assert min(gain[30], gain[300]) > 0.9 * gain[3] and gain[3] > 0.2, gain


def test_rows_are_averaged_over_the_tasks_that_used_them():
    weights = np.ones((M.BLOCK * 2, 3), dtype=np.float32)
    part = np.zeros((M.BLOCK, 5))
    part[7] = [1000, 1000 ** 2, *(1000 * np.array([1, 2, 3]))]  # one task alone used it
    part[9] = [2000, 2 * 1000 ** 2, *(1000 * np.array([1, 2, 3]))]  # of two tasks one changed it
    part[11] = [40, 4 * 10 ** 2, *(40 * np.array([1, 2, 3]))]  # four tasks, none of which settled it
    new = M._merge(weights, {1: part.ravel()})
    assert new[M.BLOCK + 7].tolist() == [2, 3, 4] and new[M.BLOCK + 9].tolist() == [1.5, 2, 2.5] and new[M.BLOCK + 11].tolist() == [3, 5, 7]
    assert (np.delete(new, M.BLOCK + np.array([7, 9, 11]), axis=0) == 1).all()


def test_probabilities_sum_to_one():
    voc = M.Vocabulary([f"w{i}".encode() for i in range(50)], np.arange(50, 0, -1), 40)
    rnd = np.random.default_rng(0)
    mass = np.append(np.append(voc.counts[:40], rnd.integers(0, 9, M.ENDINGS)), 7).astype(float)
    classes = M.cluster(rnd.integers(0, 30, (voc.size, M.ANCHORS)).astype(float), mass)
    n = classes.max() + 1
    assert len(classes) == voc.size and n <= M.CLASSES
    in_class = np.bincount(classes, weights=mass + 1, minlength=n)
    weights = rnd.normal(0, 1, (M.ROWS * M.FEATURES, n)).astype(np.float32)
    units, at = M.positions(voc, [np.arange(30, dtype=np.uint16).tobytes(), b""])
    assert len(at) == 32
    p = M.class_probabilities(weights, np.log(in_class / in_class.sum()).astype(np.float32), M.active_rows(units, at))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert math.isclose((p[3][classes] * (mass + 1) / in_class[classes]).sum(), 1, abs_tol=1e-4)


def test_awkward_tables(spark, small):
    assert scored(spark, []) == {}
    none = scored(spark, [(1, "a b"), (2, None)], F.lit(False))  # nothing to learn from
    assert none[1]["base_score"] == 0 and none[1]["n_known"] == 0 and none[1]["train_tokens"] == 0
    assert math.isfinite(none[1]["score"])
    df = spark.createDataFrame([(None, "a b", 1), (5, "a", 2), (5, "a", 2), (6, "x " * 40000, 3)], "doc_id long, text string, words int")
    got = M.maxent_scores(df, F.col("doc_id") > 0).collect()
    assert len(got) == 4 and sum(r["train"] for r in got) == 3
    assert len({(r["score"], r["base_score"]) for r in got if r["id"] == 5}) == 1


def test_words_are_cut_at_white_space_only():
    text = "a\x0bB\x0cC\rD " * 100 + "\x85x\xa0y"
    assert [w for ws in M.word_runs(text) for w in ws] == text.encode().lower().split()


def test_segment_sums_and_one_update():
    """Sums of one row up to several chunks, and the update against a plain loop over positions."""
    rnd = np.random.default_rng(3)
    sizes = [1, 3, M.CHUNK, M.CHUNK + 1, 1, 5 * M.CHUNK, 2, 6 * M.CHUNK + 5, M.CHUNK - 1]
    x, index = rnd.normal(size=(40, 5)).astype(np.float32), rnd.integers(0, 40, sum(sizes))
    first = np.cumsum([0, *sizes[:-1]])
    for k in (1, 2, len(sizes)):
        part = index[:sum(sizes[:k])]
        got, by = M.segment_sums(x, part, first[:k])
        assert sorted(by.tolist()) == list(range(k))
        assert np.allclose(got, np.add.reduceat(x[part], first[:k], axis=0)[by], atol=1e-5)

    voc = M.Vocabulary([f"w{i}".encode() for i in range(50)], np.arange(50, 0, -1), 40)
    units, at = M.positions(voc, [rnd.zipf(1.5, 300).clip(max=39).astype(np.uint16).tobytes() for _ in range(3)])
    target, prior = rnd.integers(0, 5, len(at)), np.zeros(5, dtype=np.float32)
    trainer = M.Trainer(rnd.normal(0, 0.1, (M.ROWS * M.FEATURES, 5)).astype(np.float32), prior)
    w, used = trainer.w.astype(np.float64), trainer.used.astype(np.float64)
    trainer.learn(units, at, target)
    rows = M.active_rows(units, at)
    assert len(at) <= M.MINIBATCH
    g = M.class_probabilities(w.astype(np.float32), prior, rows) - np.eye(5)[target]
    for r in np.unique(rows):
        hits = (rows == r).sum(axis=0)
        used[r] += hits.sum()
        w[r] -= M.RATE * (g * hits[:, None]).sum(axis=0) / np.sqrt(used[r] * hits.sum())
    assert np.allclose(trainer.w, w, atol=1e-5) and np.allclose(trainer.used, used)


def test_rows_of_a_minibatch_do_not_convert_the_piece():
    """op6: 32 positions of a piece of eight million units allocate little."""
    import tracemalloc

    units = np.arange(1 << 23, dtype=np.uint32).astype(np.uint16)
    tracemalloc.start()
    M.active_rows(units, np.arange(3, 35))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20


def plain_words(text):
    return text.encode().lower().split()


def odd_texts():
    rnd = random.Random(7)
    some = [" ".join(rnd.choice(("kax", "MEY", "rare%d" % rnd.randrange(40), "É", "x\xa0y")) for _ in range(rnd.randrange(60))) for _ in range(50)]
    return ["", " ", "\t\n", " a ", "É é\x85x\xa0y a\x0bB\x0cC\rD\x00e \x1cx\x1f y", *some, "lead \n\n x", "İ ſ K trail\n", "w" * 50, ""]


def test_texts_are_encoded_as_by_a_plain_loop(monkeypatch):
    """op6: words of many texts at once, in one array or, for longer texts, in runs."""
    texts = odd_texts()
    counts = Counter(w for t in texts for w in plain_words(t))
    words = sorted(counts, key=lambda w: (-counts[w], w))[:30]
    voc = M.Vocabulary(words, np.array([counts[w] for w in words]), 12)
    place = {w: i for i, w in enumerate(words)}
    for most, run in ((M.GATHERED, M.PIECE), (40, 16), (0, 1)):
        monkeypatch.setattr(M, "GATHERED", most)
        monkeypatch.setattr(M, "PIECE", run)
        got = list(zip(*(c.to_pylist() for c in voc.encode(pa.array(texts)))))
        assert len(got) == len(texts)
        for t, (units, n, known, own, shared, rare) in zip(texts, got):
            ws = plain_words(t)
            ids = [place.get(w, -1) for w in ws]
            assert np.frombuffer(units, np.uint16).tolist() == [i if 0 <= i < 12 else 12 + M.ending(w) for i, w in zip(ids, ws)]
            assert (n, known) == (len(ws), sum(i >= 0 for i in ids))
            assert math.isclose(own, sum(math.log10(counts[w] + 1) for i, w in zip(ids, ws) if 0 <= i < 12), abs_tol=1e-9)
            assert math.isclose(shared, sum(math.log10(counts[w] + 1) for i, w in zip(ids, ws) if i >= 12), abs_tol=1e-9)
            times = Counter()
            for r in rare:
                times[r["word"]] += r["n"]
            assert times == Counter(w for i, w in zip(ids, ws) if i < 0)


def test_words_not_looked_up_are_hashed_once_each(monkeypatch):
    """op6: per-word Python was a quarter of the time; now one call for each different word."""
    calls = []
    voc = M.Vocabulary([b"a"], np.array([9]), 1)
    monkeypatch.setattr(M, "ending", lambda word, real=M.ending: calls.append(word) or real(word))
    voc.encode(pa.array(["a b c b"] * 500))
    assert sorted(calls) == [b"b", b"c"]


def test_rows_are_gathered_to_bounded_batches():
    """Small batches go together, large ones are cut, and rows keep their order."""
    texts = ["x" * n for n in (5, 0, 3 << 20, 9 << 20, 7, 8, 5 << 20, 5 << 20, 1)]
    batches = [pa.record_batch([pa.array([i]), pa.array([t])], names=["i", "text"]) for i, t in enumerate(texts)]
    out = list(M.gathered(iter(batches), 1))
    assert [b.column(0).to_pylist() for b in out] == [[0, 1, 2], [3], [4, 5, 6], [7, 8]]
    assert list(M.gathered(iter([]), 1)) == [] and len(list(M.gathered(iter([pa.concat_batches(batches)]), 1))) == 4
    empty = pa.record_batch([pa.array([""] * 300000)], names=["text"])
    assert sum(b.num_rows for b in M.gathered(iter([empty] * 2), 0)) == 600000


def test_words_are_counted_in_bounded_tables(monkeypatch):
    """A task sums its counts and hands them on when they are too many; the shuffle sums again."""
    texts = [f"W{i} w{i % 7}  all\tALL " for i in range(900)] + ["", " "]
    batches = [pa.record_batch([pa.array(texts[k:k + 50])], names=["text"]) for k in range(0, len(texts), 50)]
    for most, gathered in ((M.LOOKUP, M.GATHERED), (100, 2000), (4, 1)):
        monkeypatch.setattr(M, "LOOKUP", most)
        monkeypatch.setattr(M, "GATHERED", gathered)
        got, out = Counter(), list(M.count_words(iter(batches)))
        for b in out:
            for word, n in zip(*(c.to_pylist() for c in b.columns)):
                got[word] += n
        assert got == Counter(w for t in texts for w in plain_words(t))
        assert (len(out) == 1) == (most == M.LOOKUP > 1000) and max(b.num_rows for b in out) <= most
    assert list(M.count_words(iter([]))) == []
