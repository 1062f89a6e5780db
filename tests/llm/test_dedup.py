"""Exact, line and SimHash deduplication against brute force, with awkward tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
import xxhash

from marktext.llm.components import connected_components
from marktext.llm.exact_dedup import exact_dedup
from marktext.llm.line_dedup import line_dedup
from marktext.llm.simhash import fingerprint, fingerprint_links, simhash_classes, simhash_dedup

SCHEMA = "doc_id long, text string, source string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


AWKWARD = [
    (1, "a b  c", "x"), (2, "a\tb c", "x"), (3, "abc", None), (4, None, "x"), (5, "", "x"), (6, " \n", "y"),
    (7, "a b c d", "x"), (7, "a b c d", "x"), (None, "abc", "z"), (8, "w " * 5000, "x"), (9, "w" * 5000, "x"),
    (10, "été  ", "x"), (11, "été ", "x"),
]


def test_exact_dedup_matches_brute_force(spark):
    got = exact_dedup(table(spark, AWKWARD)).collect()
    groups = defaultdict(list)
    for i, t, _ in AWKWARD:
        t = t or ""
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()].append((-len(t), i is None, i or 0, i))
    assert len(got) == len(AWKWARD)
    for r in got:
        g = groups[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["keep_id"] == min(g)[3]
    by_text = defaultdict(list)
    for r in got:
        by_text[r["text_sha256"]].append(r["kept"])
    assert all(sum(v) == 1 for v in by_text.values()), "one row of each group stays, repeated rows too"


def test_exact_dedup_bloom_filter_only_passes_singles(spark):
    rows = [(i, f"text {i % 900}", "s") for i in range(1000)]
    got = exact_dedup(table(spark, rows)).collect()
    assert sum(r["kept"] for r in got) == 900
    assert all(r["group_size"] == 1 for r in got if r["filtered"])
    assert sum(r["filtered"] for r in got) > 600, "most single rows pass the filter"
    tiny = exact_dedup(table(spark, rows), bits_per_row=1).collect()  # a bad filter costs time, not results
    key = lambda r: (r["doc_id"], r["keep_id"], r["group_size"], r["kept"])
    assert sorted(map(key, got)) == sorted(map(key, tiny))


def test_empty_tables(spark):
    none = table(spark, [])
    assert exact_dedup(none).count() == 0
    assert line_dedup(none).count() == 0
    assert simhash_classes(none).count() == 0
    assert simhash_dedup(none).columns == none.columns and simhash_dedup(none).count() == 0


def brute_lines(rows, width=3):
    """Places of every window in order of (id, line); later places cover their lines."""
    docs = {}
    for i, t in rows:
        docs[i] = [(k, x) for k, x in enumerate((t or "").split("\n")) if WORDS.search(x)]
    seen, gone = set(), defaultdict(set)
    for i in sorted(docs):
        lines = docs[i]
        for k in range(len(lines) - width + 1):
            w = tuple(x for _, x in lines[k:k + width])
            if w in seen:
                gone[i] |= {lines[k + j][0] for j in range(width)}
            seen.add(w)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}, gone


def test_line_dedup_matches_brute_force(spark):
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, "q\nq\nq\nq\nq"), (5, None), (6, ""), (7, "\n\n"),
        (8, "b\n\nc\n \nd\ne"), (9, "c\nd\ne\nf\nd\ne\nf\ng"), (10, "a\nb\nc"), (11, "\n".join(f"l{i % 50}" for i in range(3000))),
    ]
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, gone = brute_lines(rows)
    assert {i: r["text"] for i, r in got.items()} == want
    assert {i: r["n_removed"] for i, r in got.items()} == {i: len(gone[i]) for i, _ in rows}
    assert got[10]["text"] == "" and got[4]["text"] == "q"


def test_line_dedup_repeated_rows_and_clashing_names(spark):
    t = "a\nb\nc"
    rows = [(1, t, "k", 5), (1, t, "k", 5), (2, t, "k", 6), (None, t, "k", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, at int").selectExpr(
        "*", "1 as _id", "2 as lines", "3 as row", "4 as n_lines")
    got = line_dedup(df)
    assert got.columns == ["doc_id", "text", "id", "at", "_id", "lines", "row", "n_lines", "n_removed"]
    assert {(r["_id"], r["lines"], r["row"], r["n_lines"]) for r in got.collect()} == {(1, 2, 3, 3)}
    texts = sorted(((r["doc_id"] or 0, r["text"]) for r in got.collect()))
    assert texts == [(0, ""), (1, t), (1, t), (2, "")]


def brute_fingerprint(text, n=3):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k:k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "ÉtÉ b c d e", "x y z " * 400, "A\x0bB\x0cC\rD"])
def test_fingerprint(text):
    assert fingerprint(text) == brute_fingerprint(text)


def brute_components(fps, bits):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("crowded", [0, 4, 1000])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_connect_what_brute_force_connects(spark, crowded, bits):
    import random
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    fps = {0}
    for c in centres:
        for _ in range(40):
            f = c
            for _ in range(rnd.randrange(0, 6)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits, crowded)
    pairs = links.collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 * bits for a, b in pairs)
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = brute_components(fps, bits)
    assert {f: got.get(f, f) for f in fps} == want


def test_simhash_classes_on_awkward_rows(spark):
    got = simhash_classes(table(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    fps = {i: brute_fingerprint(t) for i, t, _ in AWKWARD if i is not None}
    comp = brute_components(set(fps.values()), 2)
    for r in got:
        if r["id"] is not None:
            assert r["fp"] & (1 << 64) - 1 == fps[r["id"]]
            assert r["component_id"] == min(i for i, f in fps.items() if comp[f] == comp[fps[r["id"]]])
    named = table(spark, AWKWARD).selectExpr("*", "1 as id", "2 as fp", "3 as row", "4 as _id")
    assert simhash_dedup(named).columns == named.columns and exact_dedup(named).count() == len(AWKWARD)
    kept = simhash_dedup(named).collect()
    assert len(kept) == len({comp[f] for f in fps.values()})
    assert sorted(r["doc_id"] for r in kept) == sorted({r["component_id"] for r in got})


def test_components_of_a_long_chain(spark):
    n = 400
    got = {r["node"]: r["root"] for r in connected_components(
        spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
