"""Suffix deduplication and the filter audit against brute force, with awkward tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from marktext.llm.filter_audit import RadixTrie, failure_masks, filter_audit, first_copies, range_bounds
from marktext.llm.suffix_dedup import Segments, repeated_starts, repeated_windows, suffix_dedup

SCHEMA = "doc_id long, text string, lang string"


# ---------------------------------------------------------------------------
# Suffix deduplication
# ---------------------------------------------------------------------------
def slow_dedup(texts: list[bytes], length: int):
    """Kept bytes and removed runs of every text, from all windows of all texts."""
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(gone))]
        out.append((bytes(c for c, g in zip(t, gone) if not g), spans))
    return out


def passages(rng: random.Random, n: int, alphabet: str, length: int) -> list[str]:
    """Texts that share pieces, exact copies and copies with one changed letter."""
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    common = [word(rng.randint(length // 2, 3 * length)) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.4:
            t = rng.choice(texts)
            i = rng.randrange(len(t) + 1)
            texts.append(t[:i] + word(1) + t[i + 1:])
        else:
            texts.append("".join(rng.choice(common)[rng.randint(0, length // 3):] if rng.random() < 0.4 else word(rng.randint(0, length))
                                 for _ in range(rng.randint(0, 5))))
    return texts


def removed(spark, rows, **options):
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return Counter((r["id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"], tuple((s["start"], s["stop"]) for s in r["spans"])) for r in got)


def expected(rows, length):
    texts = [(t or "").encode() for _, t, _ in rows]
    return Counter((i, kept, len(t), len(t) - len(kept), len(spans), tuple(spans))
                   for (i, _, _), t, (kept, spans) in zip(rows, texts, slow_dedup(texts, length)))


@pytest.mark.parametrize("seed,alphabet", [(1, "ab"), (2, "abcdefgh é"), (3, "abcdefghijklmnopqrstuvwxyz ")])
def test_repeated_starts_match_all_windows(seed, alphabet):
    rng = random.Random(seed)
    for length in (1, 2, 7, 20):
        texts = [t.encode() for t in passages(rng, 12, alphabet, length)]
        texts = [t for t in texts if t] or [b"x"]
        got = repeated_starts(texts, length)
        seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        want = np.concatenate([[seen[t[i:i + length]] > 1 if i + length <= len(t) else False for i in range(len(t) + 1)] for t in texts])
        assert (got == want).all()


@pytest.mark.parametrize("kmer", [1, 5, 20])
def test_segments_cover_every_window_once_and_agree(kmer):
    rng = random.Random(kmer)
    texts = [t.encode() for t in passages(rng, 40, "abcd", 20)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = list(zip(*(x.tolist() for x in Segments(20, kmer).of(data, offsets))))
    covered = Counter((t, at + k) for t, at, n, _, _ in found for k in range(n))
    assert set(covered) == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 19)} and set(covered.values()) <= {1}
    by_window, by_hash = defaultdict(set), defaultdict(set)
    for t, at, n, mini, content in found:
        by_hash[mini, content].add(texts[t][at:at + n + 19])
        for k in range(n):
            by_window[texts[t][at + k:at + k + 20]].add(mini)
    assert all(len(v) == 1 for v in by_window.values()), "equal windows meet in one bucket"
    assert all(len(v) == 1 for v in by_hash.values())


@pytest.mark.parametrize("seed,alphabet,options", [
    (1, "abcdefgh", {}), (2, "ab", {}), (3, "aé€ bcd", {}), (4, "abcdefgh", {"bucket_bytes": 1}), (5, "ab", {"bucket_bytes": 1})])
def test_suffix_dedup_matches_brute_force(spark, seed, alphabet, options):
    rows = [(i, t, "x") for i, t in enumerate(passages(random.Random(seed), 60, alphabet, 20))]
    assert removed(spark, rows, length=20, **options) == expected(rows, 20)


def test_suffix_dedup_awkward_rows(spark):
    long = "".join(random.Random(9).choice("abcdefghij") for _ in range(30_000))
    rows = [(1, None, "x"), (1, "", None), (None, "q" * 250, "x"), (None, "q" * 250, "x"), (2, "q" * 199, "x"), (3, "z" * 200, "x"),
            (4, "z" * 201, "x"), (5, long, "x"), (5, long[:7000] + "!" + long[7000:], "x"), (6, long[300:500], None), (6, "only here", "x")]
    assert removed(spark, rows) == expected(rows, 200)
    assert removed(spark, []) == Counter()


def test_suffix_dedup_of_periodic_and_chunked_text(spark, monkeypatch):
    import marktext.llm.suffix_dedup as module
    monkeypatch.setattr(module, "CHUNK", 64)  # the driver's value travels to the workers with the closure's class
    texts = [("abc" * 90).encode(), ("x" + "abc" * 50).encode(), b"k" * 130]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found = list(zip(*(x.tolist() for x in Segments(20, 5).of(data, offsets))))
    assert Counter((t, at + k) for t, at, n, _, _ in found for k in range(n)) == Counter(
        (k, i) for k, t in enumerate(texts) for i in range(len(t) - 19))


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a" * 300, 5, "v"), (2, "b", 6, "w")], "doc_id long, text string, id long, version string")
    got = {r["id"]: r["n_removed"] for r in suffix_dedup(df).collect()}
    assert got == {1: 300, 2: 0}
    labels = spark.createDataFrame([(1, 1, 0, 9)], "doc_id long, quality int, toxic int, mask int")
    docs = spark.createDataFrame([(1, "a", "en", 7, "p")], "doc_id long, text string, lang string, mask int, part string")
    assert filter_audit(docs, labels).where("kept + removed + redundant <= 1").count() == 600


# ---------------------------------------------------------------------------
# Filter audit
# ---------------------------------------------------------------------------
def slow_mask(i, text, rows) -> str:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
    fails += "D" * bool(re.search("[#$%&*|]", text))
    smaller = any((t or "") == text and (j is not None and (i is None or j < i)) for j, t, _ in rows)
    return fails + "E" * smaller


def slow_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(i, slow_mask(i, t, rows)) for i, t, lang in rows if (lang or "") == part]
        gone_by = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [(i, m) for i, m in left if f in m]
                left = [(i, m) for i, m in left if f not in m]
                gone_by[f] += len(gone)
                out[part, "".join(order), k] = [
                    len(left), len(gone), sum(f in m for _, m in own) - len(gone), sum(m == f for _, m in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(gone_by[order[k - 1]])
    return out


def audit_rows(rng: random.Random, n: int):
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.4:
            text = rng.choice(rows)[1]
        elif kind < 0.5:
            text = rng.choice([None, "", " ", "short", "short#", "SHORT"])
        else:
            text = " ".join(rng.choice(["alpha", "Beta", "GAMMA", f"w{rng.randrange(300)}", "d|e"][:rng.randint(1, 5)])
                            if kind < 0.8 else f"w{rng.randrange(900)}" for _ in range(rng.randint(90, 130)))
        rows.append((rng.choice([i, i, i, None, 3]), text, rng.choice(["en", "de", None, ""])))
    return rows


def test_filter_audit_matches_brute_force(spark):
    rng = random.Random(5)
    rows = audit_rows(rng, 120)
    labels = [(rng.choice([i, None, 900]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 0, 0), (4, 1, 1)]
    got = filter_audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got.collect()} == slow_audit(rows, labels)


def test_masks_do_not_depend_on_the_ranges(spark):
    rows = audit_rows(random.Random(6), 150) + [(500 + k, "same beginning of a text " * 40 + str(k % 20), "en") for k in range(60)]
    want = Counter((i, lang or "", sum(1 << "ABCDE".index(f) for f in slow_mask(i, t, rows))) for i, t, lang in rows)
    for size in (1, 5000, 1 << 20):
        got = failure_masks(spark.createDataFrame(rows, SCHEMA).repartition(5), range_bytes=size)
        assert Counter((r["id"], r["part"], r["mask"]) for r in got.collect()) == want


def test_ranges_follow_long_common_prefixes(spark):
    from pyspark.sql import functions as F
    texts = spark.createDataFrame([("p" * 500 + str(k),) for k in range(64)], "text string").withColumn("version", F.xxhash64("text"))
    bounds = range_bounds(texts, range_bytes=4000)
    assert len(bounds) > 10 and max(map(len, bounds)) > 500
    assert first_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_returns_every_text_with_its_least_value():
    rng = random.Random(1)
    trie, want = RadixTrie(), {}
    for k in range(3000):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        v = (False, rng.randrange(1000), 0)
        trie.insert(t, v)
        want[t] = min(v, want.get(t, v))
    assert list(trie) == sorted(want.items())


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(none, labels).count() == 0 and suffix_dedup(none).count() == 0
