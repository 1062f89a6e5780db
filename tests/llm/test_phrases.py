"""Phrase mining against a plain count of all n-grams."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marktext.llm.phrases import DoubleArray, advance, phrase_collocations

SCHEMA = "doc_id long, text string, lang string"


def slow_phrases(rows, max_words, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= min_count and len(p) > 1}
        rest = []
        for p, a in found.items():
            longer = (q for q in found if len(q) > len(p) and 100 * found[q] >= 100 * a)
            if any(q[i:i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rest)[:top], 1)]
    return sorted(out)


def corpus(rng: random.Random, n: int):
    words = ["the", "The", "of", "new", "york", "city", "ÉTÉ", "été", "été", "x-y", "“a”", "b c", "hall", "zz"]
    fixed = ["new york city hall", "of the city of the", "zz zz zz zz zz zz", "x-y  été\tthe"]
    rows = []
    for i in range(n):
        bits = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        text = "".join(b + rng.choice([" ", " ", " ", "  ", ". ", "\n", ",", "!?", "\t", "\r\n", "\x0b"]) for b in bits)
        rows.append((rng.choice([i, None, 1]), rng.choice([text, text, text, text, None, ""]), rng.choice(["en", "en", "fr", None, "und", ""])))
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"block": 9, "max_words": 3}), (3, {"top": 7, "max_words": 3})])
def test_phrases_match_a_count_of_all_ngrams(spark, seed, options):
    rows = corpus(random.Random(seed), 120)
    got = phrase_collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), min_count=12, **options)
    want = slow_phrases(rows, options.get("max_words", 5), 12, options.get("top", 2000))
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_scores_past_64_bits_are_exact(spark):
    from marktext.llm.phrases import _ranked
    a, f, n = 3_000_000_000_001, (4_000_000_000_003, 5_000_000_000_007), 90_000_000_000_017
    phrases = spark.createDataFrame([([0, 1], a)], "words array<int>, f long")
    parts = spark.createDataFrame([([0], f[0]), ([1], f[1]), ([0, 1], a)], "words array<int>, f long")
    vocabulary = spark.createDataFrame([("en", b"p", f[0], 0), ("en", b"q", f[1], 1)], "lang string, word binary, f long, id long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    assert _ranked(phrases, parts, vocabulary, totals, 10).first()["score"] == 1000 * a * n // (f[0] * f[1])


def test_long_text_repeated_rows_and_extra_columns(spark):
    text = "ab cd ef " * 4000 + "x" * 50_000
    df = spark.createDataFrame([(1, text, "en", 1, "w"), (1, text, "en", 2, "w")],
                               "doc_id long, text string, lang string, n long, words string")
    got = [tuple(r) for r in phrase_collocations(df, min_count=100).collect()]
    assert sorted(got) == slow_phrases([(1, text, "en")] * 2, 5, 100, 2000)


def test_nothing_frequent_and_empty_table(spark):
    for rows in ([], [(1, None, None)], [(1, "a b c", "en")]):
        assert phrase_collocations(spark.createDataFrame(rows, SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_double_array_finds_exactly_its_phrases(seed):
    rng = np.random.default_rng(seed)
    alphabet, depth = int(rng.choice([3, 60, 256, 70_000])), int(rng.integers(1, 5))
    numbers = np.concatenate((rng.integers(-1, alphabet, 3000), np.full(depth, -1)))
    every = {tuple(numbers[i:i + depth]) for i in range(3000) if (numbers[i:i + depth] >= 0).all()}
    chosen = [p for p in sorted(every) if rng.random() < 0.5] or sorted(every)[:1]
    digits = max(1, -(-alphabet.bit_length() // 8))
    trie = DoubleArray(rng.permutation(np.array(chosen, np.int64)), digits)
    assert len(set(trie.accept.tolist())) == len(chosen)
    at, state = advance(trie.base, trie.check, digits, numbers, depth)
    by_state = {int(s): tuple(p) for s, p in zip(trie.accept, trie.phrases.tolist())}
    want = {i: tuple(numbers[i:i + depth]) for i in range(3000) if tuple(numbers[i:i + depth]) in set(chosen)}
    assert {int(i): by_state[int(s)] for i, s in zip(at, state)} == want
