"""Character classes, the atomic mapping and the text functions."""

from __future__ import annotations

import random
import tracemalloc

from conftest import BA, FATHA, KAF, KASRA, SHADDA, SUKUN, TA, marked, mini_sentences, py_encode
from pyspark.sql import functions as F

from marktext.functions import chars as C
from marktext.functions import text as X
from marktext.operators import ambiguity as A
from marktext.operators import corpus as K


def test_mapping_size_and_closed_form():
    m = C.atomic_mapping()
    assert len(m) == 621
    slots = sorted(ord(v) - C.PUA_BASE for v in m.values())
    assert slots[0] == 0 and slots[-1] == 656
    # 36 letter+shaddah slots of the first block are never emitted.
    unused = set(range(657)) - set(slots)
    assert unused == {9 * li + 6 for li in range(36)}
    assert C.MIN_MAPPING_ENTRIES <= len(m)


def test_mapping_against_hand_written_codepoints():
    """Slots worked out by hand: letters by their place, marks in blocks of nine."""
    m = C.atomic_mapping()
    table = {
        (0x0621, 0x064B): 0xE000, (0x0621, 0x0650): 0xE005, (0x0621, 0x0652): 0xE007, (0x0621, 0x0670): 0xE008,
        (0x0622, 0x064B): 0xE009, (0x0628, 0x064E): 0xE000 + 9 * 7 + 3, (0x064A, 0x0670): 0xE000 + 9 * 35 + 8,
        (0x0621, 0x0651, 0x064B): 0xE000 + 324, (0x0621, 0x0651, 0x0670): 0xE000 + 324 + 7, (0x0621, 0x0651): 0xE000 + 324 + 8,
        (0x064A, 0x0651): 0xE000 + 324 + 9 * 35 + 8, (0x064B,): 0xE000 + 648, (0x0651,): 0xE000 + 654, (0x0670,): 0xE000 + 656,
    }
    for seq, code in table.items():
        assert ord(m[marked(*seq)]) == code, [hex(c) for c in seq]
    assert len(set(m.values())) == len(m)


def test_encode_decode_match_brute_force(spark):
    texts = mini_sentences() + ["", "abc", marked(KAF, SHADDA, SHADDA, FATHA), marked(FATHA, FATHA),
                                marked(BA, KASRA, SHADDA), marked(0x0671, SUKUN)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    out = df.select("id", "t", X.atomic_encode_builtin("t").alias("b"), X.atomic_encode_arrow("t").alias("a"),
                    X.atomic_decode_builtin(X.atomic_encode_builtin("t")).alias("db"),
                    X.atomic_decode_arrow(X.atomic_encode_arrow("t")).alias("da")).collect()
    for r in out:
        assert r["b"] == py_encode(r["t"]), r["t"]
        assert r["a"] == r["b"]
        assert r["db"] == r["t"] and r["da"] == r["t"]


def test_nfc_order_is_not_normalised(spark):
    # letter + fatha + shaddah: fatha binds to the letter, shaddah becomes a lone mark.
    t = marked(TA, FATHA, SHADDA)
    got = spark.createDataFrame([(t,)], "t string").select(X.atomic_encode("t")).first()[0]
    assert got == py_encode(t) and len(got) == 2


def test_strip_words_letters(spark):
    t = marked("  ", KAF, FATHA, TA, " ", BA, SUKUN, "　x\x1c", 0x0671, "\n")
    r = spark.createDataFrame([(t,), ("",), (None,)], "t string").select(
        X.strip_marks("t").alias("s"), X.words("t").alias("w"), X.count_base_letters("t").alias("n"),
        X.is_not_blank("t").alias("nb"), X.utf8_len("t").alias("b")).collect()
    assert r[0]["s"] == t.translate({ord(m): None for m in C.MARKS})
    assert r[0]["w"] == t.split()
    assert r[0]["n"] == 4
    assert r[0]["nb"] is True and r[0]["b"] == len(t.encode("utf-8"))
    assert r[1]["w"] == [] and r[1]["nb"] is False
    assert r[2]["w"] is None


def test_pretokenize_is_lossless_and_matches_regex_module(spark):
    import regex
    pat = regex.compile(C.SPLIT_PATTERN)
    texts = mini_sentences() + ["Hello  world!!\n\n  x", "a1234b  ", " ?? ok\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.pretokenize("t")).collect()]
    for t, toks in zip(texts, got):
        assert "".join(toks) == t
        assert toks == pat.findall(t)


def test_labels_and_classes(spark):
    rows = spark.createDataFrame([(marked(KAF, SHADDA, FATHA),), (marked(KAF),)], "s string").select(
        X.mark_label("s")).collect()
    assert [r[0] for r in rows] == ["shaddah+fathah", "bare"]
    tc = spark.createDataFrame([(marked(FATHA),), (marked(KAF),), (marked(" ", KAF, KASRA),), (marked(KAF, TA),),
                                ("abc",)], "t string").select(X.token_class("t")).collect()
    assert [r[0] for r in tc] == ["harakah", "base_letter", "pair", "other", None]
    assert spark.range(1).select(X.budget_label(F.lit(15_000_000))).first()[0] == "15M"


def test_encoding_preserves_blankness(spark):
    import random
    rng = random.Random(5)
    alphabet = [" ", "\t", "\n", "　", "x"] + list(C.MARKS) + list(C.MAP_LETTERS[:5])
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        X.is_not_blank("t").alias("a"), X.is_not_blank(X.atomic_encode("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_units_of_random_batches():
    """Whole batches against the pattern, document by document: units never cross documents."""
    rnd = random.Random(5)
    alphabet = [*map(marked, (BA, TA, KAF)), *C.MARKS, chr(C.SHADDAH), chr(0x0671), chr(0xE003), chr(0xE28F), "a", " ", "\U0001f600", "ۿ", "؀"]
    for _ in range(300):
        texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 2, 3, 12]))) for _ in range(rnd.randrange(9))]
        assert X.encode_units(texts) == [py_encode(t) for t in texts]
    units = list(C.atomic_mapping())
    assert X.encode_units(units) == list(C.atomic_mapping().values())
    assert X.encode_units(["", *mini_sentences(), ""]) == ["", *map(py_encode, mini_sentences()), ""]


def test_blocks_of_the_encoder():
    """Any block size gives the same texts; long texts are divided between units."""
    rnd = random.Random(6)
    alphabet = [*map(marked, (BA, TA, KAF)), *C.MARKS, chr(C.SHADDAH), chr(C.SHADDAH), "a", " "]
    for _ in range(100):
        texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 3, 12, 40]))) for _ in range(rnd.randrange(9))]
        assert X.encode_units(texts, size=rnd.randrange(1, 20)) == [py_encode(t) for t in texts]


def test_encoder_memory_does_not_grow_with_the_batch():
    texts = [("x" + marked(BA, FATHA, KAF) + " ") * 200] * 4000               # 4 million codepoints
    tracemalloc.start()
    X.encode_units(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000


def test_long_runs_without_marks(spark):
    """A greedy group overflowed the stack of Java's matcher on a run of some thousand characters."""
    run = "ab " + chr(BA) * 3
    df = spark.createDataFrame([(1, run * 20_000 + marked(BA, FATHA)), (2, marked(BA, FATHA))], "doc_id long, vocalized string")
    rows = K.atomic_unit_histogram(df).collect()
    assert [(r["seq"], r["n"]) for r in rows] == [(marked(BA, FATHA), 2)]
    assert df.select(X.atomic_encode_builtin("vocalized").alias("t")).collect() == df.select(X.atomic_encode("vocalized").alias("t")).collect()


def test_character_counts_over_blocks(spark):
    """Counts and first places are those of the whole, however many blocks a batch makes."""
    texts = [(7, "ab" * 300_000), (3, "b" * 600_000 + "c"), (5, "ca" * 300_000)]
    rows = A.char_counts(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), "text", (), "doc_id").collect()
    assert {r["ch"]: (r["n"], r["first_ord"], r["first_pos"]) for r in rows} == {
        "a": (600_000, 5, 1), "b": (900_000, 3, 0), "c": (300_001, 3, 600_000)}


def test_words_split_at_python_whitespace_alone(spark):
    codes = [c for c in [*range(1, 0x3100), 0xE000, 0xFEFF, 0xFFFD, 0x1F600]]
    df = spark.createDataFrame([(c, f"x{chr(c)}{chr(c)}y") for c in codes], "c int, t string")
    wrong = [r["c"] for r in df.select("c", "t", X.words("t").alias("w")).collect() if list(r["w"]) != r["t"].split()]
    assert wrong == []


def test_whitespace_class_tries_few_members(spark):
    """A codepoint above Latin-1 was held against every single member of the class, one after the other."""
    outer = C.JAVA_PYWS_CLASS
    assert outer.count("[") == 3 and f"[{chr(0x1680)}-{chr(0x3000)}&&[" in outer


def test_blank_when_stripped(spark):
    rows = [(None,), ("",), (" \n",), (chr(0x64E),), (chr(0x64E) + " " + chr(0x670),), (" a" + chr(0x64E),), (chr(0x628),)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(X.is_not_blank_stripped("t").alias("a"), X.is_not_blank(X.strip_marks("t")).alias("b")).collect()
    assert all(bool(r["a"]) == bool(r["b"]) for r in got) and sum(bool(r["a"]) for r in got) == 2
