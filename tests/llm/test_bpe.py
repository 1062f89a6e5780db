"""The tokenization automaton against the tokenizers library, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from marktext.llm.bpe_automaton import TokenAutomaton, bpe_decode, bpe_encode, read_tokenizer  # noqa: E402
from marktext.llm.queries import bpe_digest  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    return TokenAutomaton(**read_tokenizer(PATH))


def same(library, automaton, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = automaton.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want, text
    assert automaton.decode(got) == library.decode(want, skip_special_tokens=False)


def test_every_code_point(library, automaton):
    step = 64
    for base in [*range(0, 0xD800, step), *range(0xE000, 0x30000, step), *range(0xE0000, 0xE0200, step)]:
        chars = [chr(c) for c in range(base, base + step)]
        same(library, automaton, " ".join(f"a{c}b" for c in chars) + "".join(f"{c}{c} {c}  " for c in chars))


def test_random_texts(library, automaton):
    rnd = random.Random(3)
    pieces = ["a", "aa", "b", "er", "the", " ", " ", " ", "  ", "\n", "\t", "\r\n", "\xa0", "　", " ", "é", "ß", "1", "22",
              "'s", "'ll", "!", "!!!", "----", "<|endoftext|>", "ción", "z", "中", "\U0001f600", "\x00", "\x1c"]
    for _ in range(4000):
        same(library, automaton, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(30))))


@pytest.mark.parametrize("text", ["", " ", "  ", "a ", " a", "a  ", "a" * 3000, " " * 3000 + "x", "ab" * 2000, "<|endoftext|>" * 3,
                                  "x <|endoftext|>  y\n", "\n\n a\n", "THEtheThe" * 500])
def test_edges(library, automaton, text):
    same(library, automaton, text)


def test_small_memories_change_nothing(library, monkeypatch):
    from marktext.llm import bpe_automaton as B
    monkeypatch.setattr(B, "WORDS_KEPT", 3)
    monkeypatch.setattr(B, "ARC_SLOTS", 4)
    monkeypatch.setattr(B, "FIRST_KEPT", 2)
    small = TokenAutomaton(**read_tokenizer(PATH))
    same(library, small, "the quick brown fox jumps over the lazy dog and the quick cat " * 3)


def brute_merges(word, merges):
    """Textbook BPE: apply the merge of the lowest rank, leftmost first, until none applies."""
    rank = {(a, b): (k, c) for k, (a, b, c) in enumerate(merges)}
    ids = list(word)
    while True:
        found = [(rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        if not found:
            return ids
        _, i = min(found)
        ids[i:i + 2] = [rank[ids[i], ids[i + 1]][1]]


@pytest.mark.parametrize("seed", range(12))
def test_gadgets_on_random_merge_lists(seed):
    """Any merge list, with self-pairs, overlaps and merges that never apply."""
    rnd = random.Random(seed)
    labels, merges = {b: bytes([b]) for b in range(256)}, []
    alphabet = [97, 98, 99]
    while len(merges) < 14:
        a, b = rnd.choice(alphabet), rnd.choice(alphabet)
        label = labels[a] + labels[b]
        if label in labels.values() or len(label) > 9:
            continue
        new = 256 + len(merges)
        labels[new] = label
        merges.append((a, b, new))
        alphabet.append(new)
    auto = TokenAutomaton(labels, merges)
    for _ in range(400):
        word = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 14)))
        assert auto.encode_word(word) == brute_merges(word, merges)


def test_tables(spark, library):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (2, None, "x"), (3, "", None), (None, "a <|endoftext|> b", "y"), (4, "w " * 30000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spec string")
    coded = bpe_decode(bpe_encode(df, PATH), PATH)
    assert coded.columns == ["doc_id", "text", "spec", "ids", "decoded"]
    for r in coded.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    both = bpe_encode(df, PATH, decoded_col="back").select("ids", "back").collect()
    assert sorted((bytes(r["ids"]), r["back"]) for r in both) == sorted((bytes(r["ids"]), r["decoded"]) for r in coded.collect())
    digest = bpe_digest(df.select("doc_id", "text"), PATH).collect()
    assert len(digest) == len(rows)
    for r in digest:
        if r["doc_id"] == 3:
            assert r["n_tokens"] == 0 and r["ids_sha256"] == r["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe_digest(df.limit(0).select("doc_id", "text"), PATH).count() == 0
    clash = bpe_encode(df.withColumnRenamed("spec", "ids"), PATH)
    assert clash.columns == ["doc_id", "text", "ids"] and clash.where("doc_id = 3").first()["ids"] == b""
