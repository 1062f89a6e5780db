"""Tokenizer jobs against a plain-Python byte-level BPE (golden merges)."""

from __future__ import annotations

import math
from collections import Counter

import regex
from conftest import mini_sentences
from pyspark.sql import functions as F

from marktext.functions import chars as C
from marktext.operators import tokens as TK


def py_bpe(texts, n_merges):
    pat = regex.compile(C.SPLIT_PATTERN)
    words = Counter(tuple(p.encode("utf-8")) for t in texts for p in pat.findall(t))
    merges = []
    for r in range(n_merges):
        pairs = Counter()
        for w, f in words.items():
            for a, b in zip(w, w[1:]):
                pairs[(a, b)] += f
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda kv: (-kv[1], kv[0]))
        new = 256 + r
        merges.append((a, b, new, n))
        nxt = Counter()
        for w, f in words.items():
            out, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and w[i] == a and w[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            nxt[tuple(out)] += f
        words = nxt
    return merges


def test_bpe_train_matches_python(spark):
    texts = mini_sentences() * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    merges = TK.bpe_train(TK.pretoken_histogram(docs), 256 + 4 + 20)
    got = [(r["left"], r["right"], r["token_id"], r["count"]) for r in merges.orderBy("rank").collect()]
    assert got == py_bpe(texts, 20)


def test_encode_decode_roundtrip_and_specials(spark):
    texts = mini_sentences() + [chr(0xE000) + chr(0xE001) + " " + chr(0xE002), "plain ascii 42!"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    merges = TK.bpe_train(TK.pretoken_histogram(docs), 256 + 4 + 15)
    rt = TK.roundtrip_check(docs, merges).first()
    assert rt["docs"] == len(texts) and rt["mismatches"] == 0
    vocab = TK.vocab_table(spark, merges)
    vs = TK.vocab_size(vocab).first()
    assert vs["n_ranks"] == 256 + 15 and vs["vocab_size"] == 256 + 15 + 4 and vs["first_special_id"] == 271
    enc = TK.bpe_encode(docs, merges, bos_id=vs["first_special_id"]).orderBy("doc_id").first()
    assert enc["ids"][0] == 271


def test_token_bytes_quirk(spark):
    merges = spark.createDataFrame([], "rank int, left int, right int, token_id int, count bigint")
    tb = {r["token_id"]: r["n_bytes"] for r in TK.token_bytes(TK.vocab_table(spark, merges)).collect()}
    assert tb[ord("a")] == 1
    assert tb[0xD8] == 3            # lone lead byte decodes to U+FFFD (3 bytes)
    assert tb[256] == 0             # special token
    raw = {r["token_id"]: r["n_bytes"] for r in TK.token_bytes(TK.vocab_table(spark, merges), true_bytes=True).collect()}
    assert raw[0xD8] == 1


def test_bpb_masks_specials_and_zero_bytes(spark):
    tb = spark.createDataFrame([(1, 2), (2, 0)], "token_id int, n_bytes int")
    loss = spark.createDataFrame([(0, 1, 1.0), (1, 2, 5.0), (2, 1, 3.0)], "pos long, token_id int, loss_nats double")
    r = TK.bpb(loss, tb).first()
    assert r["total_bytes"] == 4 and r["valid_tokens"] == 2 and abs(r["total_nats"] - 4.0) < 1e-12
    assert abs(r["bpb"] - 4.0 / (math.log(2) * 4)) < 1e-12
    z = TK.bpb(loss.where("token_id = 2"), tb).first()
    assert z["bpb"] == float("inf") and z["total_bytes"] == 0


def test_prefix_by_chars_keeps_crossing_doc(spark):
    docs = spark.createDataFrame([(i, i, "x" * 10) for i in range(10)], "doc_id long, ordinal long, text string")
    got = TK.prefix_by_chars(docs, max_chars=25, doc_cap=8)
    assert sorted(r["ordinal"] for r in got.collect()) == [0, 1, 2, 3]
    assert {len(r["text"]) for r in got.collect()} == {8}


def test_fertility(spark):
    texts = mini_sentences()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    merges = TK.bpe_train(TK.pretoken_histogram(docs), 256 + 4)
    f = TK.fertility(docs, merges).first()
    assert f["words"] == sum(len(t.split()) for t in texts)
    assert f["tokens"] == sum(len(t.encode("utf-8")) for t in texts)
    assert abs(f["fertility"] - f["tokens"] / f["words"]) < 1e-12
    assert F is not None


def test_guessed_training_equals_sequential(spark, mini_corpus):
    """Few guesses a job, and a head that misleads: one word of all."""
    texts = [r["vocalized"] for r in mini_corpus.collect()] + ["the cat sat on the mat " * 3, "abab abab ab"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    hist = TK.pretoken_histogram(docs).checkpoint()
    want = py_bpe(texts, 40)
    for options in ({}, {"batch": 7}, {"head_words": 1}, {"head_words": 6, "batch": 16}):
        got = TK.bpe_train(hist, 256 + 4 + 40, **options).orderBy("rank").collect()
        assert [(r["left"], r["right"], r["token_id"], r["count"]) for r in got] == want, options


def test_training_ends_when_no_pair_is_left(spark):
    hist = spark.createDataFrame([("ab", 3), ("abc", 1), ("", 4), (None, 2), ("z", 9)], "pretoken string, freq long")
    assert [(r["left"], r["right"], r["count"]) for r in TK.bpe_train(hist, 8192).orderBy("rank").collect()] == [(97, 98, 4), (256, 99, 1)]
    assert [r["count"] for r in TK.bpe_train(hist, 8192, min_count=2).collect()] == [4]
    assert TK.bpe_train(hist.limit(0), 8192).count() == 0


def test_encoding_by_heap_equals_repeated_scans():
    import random

    def slow(word, ranks):
        ids, applied = list(word), []
        while hits := [(ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]:
            rank, i = min(hits)
            applied.append(rank)
            ids[i:i + 2] = [ranks[ids[i], ids[i + 1]][1]]
        return ids, applied

    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("aab") for _ in range(rng.randint(5, 60)))
        ranks = {(a, b): (r, new) for r, (a, b, new, _) in enumerate(py_bpe([text], rng.randint(0, 12)))}
        word = bytes(rng.choice(b"aab") for _ in range(rng.randint(0, 40)))
        got = TK.bpe_steps(word, ranks)
        assert got == slow(word, ranks) and got[1] == sorted(got[1])


def test_fertility_by_size_equals_smaller_vocabularies(spark):
    texts = mini_sentences() * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    hist = TK.pretoken_histogram(docs).checkpoint()
    merges = TK.bpe_train(hist, 256 + 4 + 30)
    got = {r["vocab_size"]: (r["tokens"], r["words"]) for r in TK.fertility_by_size(docs, hist, merges, (260, 265, 290, 999)).collect()}
    for size in (260, 265, 290):
        want = TK.fertility(docs, merges.where(F.col("rank") < size - 260)).first()
        assert got[size] == (want["tokens"], want["words"])
    assert got[999] == got[290]


def test_self_pairs_end_a_batch(spark):
    """Merging (a, a) can create (new, new), which may come before pairs ranked by now."""
    hist = spark.createDataFrame([("aaaa", 40), ("cd", 20)], "pretoken string, freq long")
    got = TK.bpe_train(hist, 256 + 4 + 3).orderBy("rank").collect()
    assert [(r["left"], r["right"]) for r in got] == [(97, 97), (256, 256), (99, 100)]


def test_random_histograms_equal_sequential_training(spark):
    import random
    for seed in range(20):
        rng = random.Random(seed)
        hist = {"".join(rng.choice("aab") if seed % 2 else rng.choice("abcd") for _ in range(rng.randint(2, 9))): rng.randint(1, 30)
                for _ in range(12)}
        df = spark.createDataFrame(sorted(hist.items()), "pretoken string, freq long").coalesce(1)
        got = TK.bpe_train(df, 256 + 4 + 8).orderBy("rank").collect()
        want = py_bpe([w for w, n in hist.items() for _ in range(n)], 8)
        assert [(r["left"], r["right"], r["token_id"], r["count"]) for r in got] == want, seed


def test_a_batch_of_merges_equals_one_at_a_time():
    """Tasks and the driver's head report, for each merge, what sequential training changes."""
    import random

    import numpy as np

    from marktext.operators import bpe_train as B

    def pairs_of(words):
        c = Counter()
        for w, f in words:
            for p in zip(w, w[1:]):
                c[p] += f
        return c

    for seed in range(60):
        rng = random.Random(seed)
        words = [(tuple(rng.choice((1, 1, 2) if seed % 2 else (1, 2, 3, 4)) for _ in range(rng.randint(1, 12))), rng.randint(1, 9)) for _ in range(15)]
        symbols = np.array([x for w, _ in words for x in (*w, -1)], np.int32)
        freqs = np.array([f for _, f in words], np.int64)
        head, merges, want, now = B.Head(symbols, freqs), [], [], words
        for new in range(5, 5 + rng.randint(1, 8)):
            counts = pairs_of(now)
            if not counts:
                break
            a, b = rng.choice(sorted(counts))
            after = []
            for w, f in now:
                out = []
                for x in w:                              # left to right; a made symbol is never the left of the pair
                    if out and x == b and out[-1] == a:
                        out[-1] = new
                    else:
                        out.append(x)
                after.append((tuple(out), f))
            change = pairs_of(after)
            change.subtract(counts)
            want.append({p: n for p, n in change.items() if n})
            keys, n = head.merge((a, b), new)
            assert {(k >> B.BITS, k & B.MASK): v for k, v in zip(keys.tolist(), n.tolist()) if v} == want[-1]
            merges.append((a, b))
            now = after
        ranked = {p: r for r, p in reversed(list(enumerate(merges)))}
        if not merges or len(ranked) < len(merges):
            continue
        got_symbols, got_freqs, keys, n = B.merge_words(symbols, freqs, merges, 5)
        assert Counter(zip("".join(f"{x} " for x in got_symbols).split("-1 ")[:-1], got_freqs.tolist())) == Counter(
            ("".join(f"{x} " for x in w), f) for w, f in now)
        steps = [{} for _ in merges]
        for k, v in zip(keys.tolist(), n.tolist()):
            steps[k >> 2 * B.BITS][k >> B.BITS & B.MASK, k & B.MASK] = v
        assert steps == want


def test_no_limits_by_default(spark):
    docs = spark.createDataFrame([(i, i, "x" * 20_000) for i in range(3)], "doc_id long, ordinal long, text string")
    assert [r["n"] for r in TK.prefix_by_chars(docs).selectExpr("length(text) n").collect()] == [20_000] * 3


def test_batches_restart_per_shard(spark):
    docs = spark.range(10).withColumnRenamed("id", "ordinal")
    got = TK.doc_batches(docs, batch_size=2, docs_per_shard=5, epochs=2).collect()
    assert sorted({(r["ordinal"], r["shard"], r["batch"]) for r in got}) == [
        (o, o // 5, o % 5 // 2) for o in range(10)] and len(got) == 20


def test_token_unigram_bpb(spark):
    texts = ["ab ab", "ab c", "ab d"]
    docs = spark.createDataFrame([(i, t, "val" if i == 2 else "train") for i, t in enumerate(texts)], "doc_id long, text string, split string")
    merges = TK.bpe_train(TK.pretoken_histogram(docs), 256 + 4 + 1)
    r = TK.token_unigram_bpb(docs, merges).first()
    # Train tokens: two BOS, ab three times, " ", " ", "a"/"b" merged or " ab" pieces: count by the encoder itself.
    enc = {x["doc_id"]: x["ids"] for x in TK.bpe_encode(docs, merges, bos_id=257).collect()}
    c = Counter(t for i in (0, 1) for t in enc[i])
    nats = -sum(math.log((c[t] + 1) / (sum(c.values()) + len(c) + 1)) for t in enc[2] if t != 257)
    assert r["total_bytes"] == 4 and r["valid_tokens"] == len(enc[2]) - 1 and abs(r["total_nats"] - nats) < 1e-9


def test_rounds_do_not_grow_with_words_that_the_driver_does_not_hold(spark):
    """Close counts that the most frequent words do not show: a few rounds all the same."""
    import random
    rng = random.Random(5)
    hist = Counter("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(8000))
    df = spark.createDataFrame(sorted(hist.items()), "pretoken string, freq long").coalesce(2).checkpoint()
    group = "rounds-of-training"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = TK.bpe_train(df, 256 + 4 + 300, head_words=1000).orderBy("rank").collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == TK.bpe_train(df, 256 + 4 + 300).orderBy("rank").collect()
    assert jobs <= 80


def test_chunks_have_the_pretokens_and_words_of_their_texts(spark):
    import random
    rng = random.Random(1)
    parts = [" ", " ", "  ", "\n", "\r\n", "\t", chr(0xA0), chr(0x2003), chr(0x1C), "a", "Bc", "7", "123", ".", "!?", "'", chr(0x0628) + chr(0x064E), chr(0x064E), chr(0xE001), chr(0x1F600), ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    pat = regex.compile(C.SPLIT_PATTERN)
    want = Counter(p for t in texts for p in pat.findall(t))
    chunks = TK.chunk_counts(docs).checkpoint()
    assert {r["pretoken"]: r["freq"] for r in TK.pretokens_of(chunks).collect()} == want
    assert chunks.agg(F.sum("texts")).first()[0] == 401
    merges = spark.createDataFrame([], "rank int, left int, right int, token_id int, count bigint")
    hist = TK.pretoken_histogram(docs)
    a, b = TK.fertility_by_size(docs, hist, merges, (260,)).first(), TK.fertility_by_size(chunks, hist, merges, (260,), text_col="chunk", n_col="n").first()
    assert a == b and a["words"] == sum(len(t.split()) for t in texts)


def test_encoding_a_batch_equals_word_by_word(spark):
    import random
    rng = random.Random(2)
    texts = ["".join(rng.choice("aab  .") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    merges = py_bpe(texts, 25)
    ranks = {(a, b): (r, new) for r, (a, b, new, _) in enumerate(merges)}
    table = spark.createDataFrame([(r, *m) for r, m in enumerate(merges)], "rank int, left int, right int, token_id int, count bigint")
    pat = regex.compile(C.SPLIT_PATTERN)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["text"], r["ids"]) for r in TK.bpe_encode(docs, table, keep=("text",), bos_id=999).collect()}
    assert got == {i: (t, [999, *(x for p in pat.findall(t or "") for x in TK.bpe_steps(p.encode(), ranks)[0])]) for i, t in enumerate([*texts, None])}
    words = TK.WordIds([(a, b) for a, b, _, _ in merges], most=3)     # forgets between batches
    for some in (["ab", "aab"], ["b", "aab", "aaaa", "ab"], ["aab"], []):
        slots = words.slots_of(some)
        assert [words.ids[words.first[i]:words.first[i + 1]].tolist() for i in slots] == [TK.bpe_steps(w.encode(), ranks)[0] for w in some]
    profile = Counter()
    for w, n in Counter(p for t in texts for p in pat.findall(t)).items():
        profile.update({-1: len(w) * n})
        for r in TK.bpe_steps(w.encode(), ranks)[1]:
            profile[r] += n
    assert {r["rank"]: r["applied"] for r in TK.merge_profile(TK.pretoken_histogram(docs), table).collect()} == profile
