"""B6 best-fit packing: properties of the rows and of the choice at every step."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from marktext.operators import packing as PK


def pieces_of(n, longest, seed=11):
    """Pieces of unique tokens, so that every token can be traced."""
    rng, out, tok = random.Random(seed), [], 0
    for _ in range(n):
        k = rng.randint(0, longest)
        out.append(list(range(tok, tok + k)))
        tok += k
    return out


@pytest.mark.parametrize("capacity,buffer_size", [(65, 50), (129, 300), (33, 1000), (1, 5)])
def test_every_token_is_placed_once_and_rows_are_full(capacity, buffer_size):
    pieces = pieces_of(700, min(capacity, 90))
    rows, cropped = PK.best_fit_rows(pieces, capacity, buffer_size, refill_batch=16)
    assert cropped == 0 and all(len(r) == capacity for r in rows)
    placed = Counter(t for r in rows for t in r if t != -1)
    assert placed == Counter(t for p in pieces for t in p)
    assert all(-1 not in r for r in rows[:-1]), "only the last row is padded"


def test_longest_fitting_piece_is_taken():
    """With a buffer that holds everything the best choice is visible in the rows."""
    pieces = [[1] * 5, [2] * 3, [3] * 4, [4] * 2, [5] * 3]
    rows, _ = PK.best_fit_rows(pieces, 8, 100)
    # 5 leaves 3: the earliest of length 3; 4 leaves 4: the other 3, then 1 of the 2.
    assert rows == [[1] * 5 + [2] * 3, [3] * 4 + [5] * 3 + [4], [4] + [-1] * 7]


def test_no_longer_piece_would_have_fitted():
    pieces = pieces_of(300, 40, seed=3)
    rows, _ = PK.best_fit_rows(pieces, 41, 10_000)
    start = {p[0]: p for p in pieces if p}
    waiting = dict(start)
    for row in rows:
        at = 0
        while at < len(row) and row[at] != -1:
            piece = waiting.get(row[at])
            if piece is None or row[at:at + len(piece)] != piece:
                break  # the head or the tail of a divided piece ends the whole pieces of this row
            room = len(row) - at
            assert not any(len(piece) < len(q) <= room for q in waiting.values())
            at += len(waiting.pop(row[at]))


def test_crop_discards_tails():
    rows, cropped = PK.best_fit_rows([[1] * 6, [2] * 6], 8, 10, crop=True)
    assert rows == [[1] * 6 + [2] * 2] and cropped == 4


def test_pack_sequences_places_all_tokens(spark):
    rows = [(i, [0] + list(range(1, (i % 37) + 3))) for i in range(400)] + [(400, list(range(1000))), (401, [])]
    docs = spark.createDataFrame(rows, "ordinal long, ids array<int>")
    packed = PK.pack_sequences(docs, seq_len=63, buffer_size=40, group_tokens=1500)
    got = packed.collect()
    assert got and all(len(r["tokens"]) == 64 and len(r["input"]) == 63 for r in got)
    assert all(r["input"][1:] == r["target"][:-1] for r in got)
    assert len({r["pack_group"] for r in got}) > 4, "also the long document spreads"
    assert Counter(t for r in got for t in r["tokens"] if t != -1) == Counter(t for _, ids in rows for t in ids)
    totals = PK.pack_totals(packed, docs, seq_len=63).first()
    assert totals["tokens_in"] == totals["tokens_placed"] and totals["rows_full"]


def test_placements_are_those_of_the_packed_rows(spark):
    ids = {i: list(range(1000 * i, 1000 * i + (i * 13) % 97)) for i in range(120)} | {120: list(range(10 ** 6, 10 ** 6 + 900))}
    docs = spark.createDataFrame([(f"k{i:04d}", x) for i, x in ids.items()], "key string, ids array<int>")
    size = {"seq_len": 31, "buffer_size": 20, "group_tokens": 700, "refill_batch": 7}
    packed = {(r["pack_group"], r["row_no"]): r["tokens"] for r in PK.pack_sequences(docs, order_col="key", **size).collect()}
    sizes = docs.selectExpr("key", "size(ids) AS n")
    placed = PK.pack_placements(sizes, order_col="key", **size).collect()
    got = {}
    for r in placed:
        row = packed[r["pack_group"], r["row_no"]]
        part = row[r["row_at"]:r["row_at"] + r["tokens"]]
        assert part == ids[int(r["ord"][1:])][r["start"]:r["start"] + r["tokens"]]
        got[r["ord"]] = got.get(r["ord"], 0) + r["tokens"]
    assert got == {f"k{i:04d}": len(x) for i, x in ids.items() if x}


def test_groups_found_by_join_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [i] * (i % 50)) for i in range(200)], "ordinal long, ids array<int>")
    size = {"seq_len": 15, "buffer_size": 20, "group_tokens": 300}
    looked_up = sorted(map(str, PK.pack_sequences(docs, **size).collect()))
    monkeypatch.setattr(PK, "MAX_CUTS", 3)
    assert sorted(map(str, PK.pack_sequences(docs, **size).collect())) == looked_up


def test_token_arrays_are_exchanged_once(spark):
    docs = spark.createDataFrame([(i, [i] * 40) for i in range(50)], "ordinal long, ids array<int>")
    plan = PK.pack_sequences(docs, seq_len=15)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") == 1


def test_no_documents(spark):
    docs = spark.createDataFrame([], "ordinal long, ids array<int>")
    assert PK.pack_sequences(docs).collect() == [] and PK.pack_placements(docs.selectExpr("ordinal", "size(ids) AS n")).collect() == []


def test_a_group_is_packed_in_arrow_buffers():
    """Token lists as Python objects and their copies took several times a group's tokens."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    n, size = 1000, 2049
    flat = np.arange(n * size, dtype=np.int32)
    order = np.random.default_rng(5).permutation(n)
    table = pa.table({"pack_group": pa.array([7] * n, pa.int64()), "ord": pa.array(order, pa.int64()), "at": pa.array([0] * n, pa.int32()),
                      "ids": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(flat))})
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    rows, cropped = PK._pack_group(table, size, 1000, -1, 128, False)
    made = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert made < 1.5 * flat.nbytes and cropped == 0
    assert rows.column("row_no").to_pylist() == list(range(n)) and set(rows.column("pack_group").to_pylist()) == {7}
    # All pieces fill a row, so the earliest is taken each time: the rows are the pieces by ord.
    assert rows.column("tokens").to_pylist() == [flat[i * size:(i + 1) * size].tolist() for i in np.argsort(order)]
