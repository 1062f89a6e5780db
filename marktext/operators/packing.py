"""Sequence packing.

Best-fit packing is sequential by nature, so it runs per *pack group*: a stretch of the
corpus of about ``group_tokens`` tokens, packed by one ``applyInArrow`` call; groups run
in parallel.  Documents are first cut into pieces of at most a row, so nothing is cropped
and a document of any length spreads over as many groups as it needs.  Within a group:

* keep a buffer of up to ``buffer_size`` pieces (the first of a document starts with BOS);
* fill a row of ``seq_len + 1`` tokens with the longest buffered piece that fits
  (earliest on ties); if none fits, the head of the shortest (earliest) fills the row and
  its tail goes back to the buffer;
* when the group runs dry, the last row is filled up with ``pad_id``.

``crop=True`` discards those tails and the last short row, as the studied loader does.

Scale notes
-----------
* Packing is decided on lengths alone (``best_fit_plan``); ``pack_placements`` moves no token.
* Group bounds come from (key, length).  Up to ``MAX_CUTS`` of them (one key a group) go to the
  tasks, which look up each document's group where it is read; beyond that, documents are joined
  to their running sum.  Token arrays are exchanged once, by group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_before
from .tokens import shift_targets

#: Group bounds that are sent to every task (a key each).
MAX_CUTS = 1 << 20


def best_fit_plan(lengths: list[int], capacity: int, buffer_size: int, refill_batch: int = 128,
                  crop: bool = False) -> tuple[list[list[tuple[int, int, int]]], int]:
    """Rows as lists of ``(piece, start, stop)``, and the number of cropped tokens.

    The buffer is topped up ``refill_batch`` pieces at a time while it holds fewer than
    ``buffer_size`` (so it may briefly hold up to ``buffer_size + refill_batch - 1``).
    """
    import bisect

    buf: list[tuple[int, int]] = []          # sorted (length left, arrival)
    begun: dict[int, int] = {}               # first token left of a divided piece
    taken, cropped, rows = 0, 0, []

    def refill():
        nonlocal taken
        while len(buf) < buffer_size and taken < len(lengths):
            for i in range(taken, min(taken + refill_batch, len(lengths))):
                if lengths[i]:
                    bisect.insort(buf, (lengths[i], i))
            taken = min(taken + refill_batch, len(lengths))

    refill()
    while buf:
        row, room = [], capacity
        while room and buf:
            fits = bisect.bisect_right(buf, (room, len(lengths)))
            if fits:
                length, _ = buf[fits - 1]
                _, i = buf.pop(bisect.bisect_left(buf, (length, -1)))   # the earliest of that length
                at, take = begun.pop(i, 0), length
            else:
                length, i = buf.pop(0)                                  # the shortest, earliest
                at, take = begun.pop(i, 0), room
                if crop:
                    cropped += length - room
                else:
                    bisect.insort(buf, (length - room, i))
                    begun[i] = at + room
            row.append((i, at, at + take))
            room -= take
            refill()
        if room and crop:
            cropped += capacity - room
            break
        rows.append(row)
    return rows, cropped


def best_fit_rows(pieces: list[list[int]], capacity: int, buffer_size: int, pad_id: int = -1,
                  refill_batch: int = 128, crop: bool = False) -> tuple[list[list[int]], int]:
    """Pack token lists into rows of ``capacity``; returns (rows, cropped tokens)."""
    plan, cropped = best_fit_plan([len(p) for p in pieces], capacity, buffer_size, refill_batch, crop)
    rows = [[t for i, a, b in row for t in pieces[i][a:b]] for row in plan]
    return [r + [pad_id] * (capacity - len(r)) for r in rows], cropped


def _windows(sizes: DataFrame, group_tokens: int) -> DataFrame:
    """``(ord, n)`` plus ``window``: the stretch of ``group_tokens`` tokens a document starts in."""
    return (running_before(sizes, ("ord",), "n")
            .withColumn("window", F.floor(F.col("before") / group_tokens).cast("bigint")).drop("before"))


def _with_window(docs: DataFrame, sizes: DataFrame, group_tokens: int) -> DataFrame:
    """``docs (ord, ...)`` plus ``window``; the documents are not shuffled unless there are too many
    windows to send their first keys to every task."""
    windows = _windows(sizes, group_tokens)
    firsts = windows.groupBy("window").agg(F.min("ord").alias("ord")).limit(MAX_CUTS + 1).collect()
    if len(firsts) > MAX_CUTS:
        return docs.join(windows.select("ord", "window"), "ord")
    firsts.sort(key=lambda r: r["window"])
    shared = docs.sparkSession.sparkContext.broadcast(([r["ord"] for r in firsts], [r["window"] for r in firsts]))

    def find(keys):
        import bisect

        import pandas as pd
        cuts, names = shared.value
        return pd.Series([names[bisect.bisect_right(cuts, k) - 1] for k in keys], dtype="int64")

    return docs.withColumn("window", F.pandas_udf(find, "bigint")("ord"))


def _pieces(n: Column, capacity: int) -> Column:
    """Start of every piece of a document of ``n`` tokens."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(capacity)))


def _group(group_tokens: int) -> Column:
    # A long document's later stretches go to the following groups: a group holds fewer than three
    # times its tokens.
    return (F.col("window") + F.floor(F.col("at") / group_tokens)).cast("bigint")


def _pack_group(table: pa.Table, capacity: int, buffer_size: int, pad_id: int, refill_batch: int,
                crop: bool) -> tuple[pa.Table, int]:
    """Packed rows ``(pack_group, row_no, tokens)`` of one group's pieces ``(pack_group, ord, at, ids)``.

    A group holds millions of tokens: they are read where they lie in Arrow's buffer and written once, into
    the buffer of the result.
    """
    order = pc.sort_indices(table.select(["ord", "at"]), sort_keys=[("ord", "ascending"), ("at", "ascending")]).to_numpy()
    ids = table.column("ids").combine_chunks()
    offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    first, lengths = offsets[:-1][order].tolist(), np.diff(offsets)[order].tolist()
    plan, cropped = best_fit_plan(lengths, capacity, buffer_size, refill_batch, crop)
    rows = np.full(len(plan) * capacity, pad_id, dtype=np.int32)
    for r, row in enumerate(plan):
        at = r * capacity
        for i, a, b in row:
            rows[at:at + b - a] = flat[first[i] + a:first[i] + b]
            at += b - a
    group = table.column("pack_group")[0].as_py()
    tokens = pa.ListArray.from_arrays(pa.array(np.arange(len(plan) + 1) * capacity, pa.int32()), pa.array(rows))
    return pa.table({"pack_group": pa.array([group] * len(plan), pa.int64()),
                     "row_no": pa.array(range(len(plan)), pa.int32()), "tokens": tokens}), cropped


def pack_sequences(docs: DataFrame, ids_col: str = "ids", order_col: str = "ordinal",
                   seq_len: int = 2048, buffer_size: int = 1000, group_tokens: int = 1 << 22,
                   pad_id: int = -1, refill_batch: int = 128, crop: bool = False,
                   sizes: DataFrame | None = None) -> DataFrame:
    """``(pack_group, row_no, tokens, input, target, group_cropped)`` packed rows.

    ``docs`` carries one token list per document and a unique, non-null ``order_col``; ``sizes``
    (``order_col``, ``n``), the lists' lengths, saves making the lists to find the groups.
    """
    capacity = seq_len + 1
    if sizes is None:
        sizes = docs.select(order_col, F.size(ids_col).alias("n"))
    sizes = sizes.select(F.col(order_col).alias("ord"), F.col("n").cast("bigint").alias("n"))
    placed = _with_window(docs.select(F.col(order_col).alias("ord"), F.col(ids_col).alias("ids")), sizes, group_tokens)
    pieces = (placed.select("window", "ord", "ids", F.explode(_pieces(F.size("ids"), capacity)).alias("at"))
              .select(_group(group_tokens).alias("pack_group"), "ord", "at", F.slice("ids", F.col("at") + 1, capacity).alias("ids")))

    def pack(table):
        rows, cropped = _pack_group(table, capacity, buffer_size, pad_id, refill_batch, crop)
        return rows.append_column("group_cropped", pa.array([cropped] * len(rows), pa.int64()))

    packed = pieces.groupBy("pack_group").applyInArrow(
        pack, "pack_group bigint, row_no int, tokens array<int>, group_cropped bigint")
    inp, tgt = shift_targets(F.col("tokens"))
    return packed.select("pack_group", "row_no", "tokens", inp.alias("input"), tgt.alias("target"),
                         "group_cropped")


def pack_placements(sizes: DataFrame, size_col: str = "n", order_col: str = "ordinal", seq_len: int = 2048,
                    buffer_size: int = 1000, group_tokens: int = 1 << 22, refill_batch: int = 128,
                    crop: bool = False) -> DataFrame:
    """Where :func:`pack_sequences` puts every token, from the documents' lengths alone:
    ``(pack_group, row_no, row_at, ord, start, tokens)``, a row per stretch of a document that lies
    together in a packed row."""
    capacity = seq_len + 1
    keys = sizes.select(F.col(order_col).alias("ord"), F.col(size_col).cast("bigint").alias("n"))
    key_type = keys.schema["ord"].dataType.simpleString()
    pieces = (_windows(keys, group_tokens).select("window", "ord", "n", F.explode(_pieces(F.col("n"), capacity)).alias("at"))
              .select(_group(group_tokens).alias("pack_group"), "ord", "at",
                      F.least(F.lit(capacity), F.col("n") - F.col("at")).cast("int").alias("n")))

    def place(pdf):
        import pandas as pd
        pdf = pdf.sort_values(["ord", "at"])
        plan, _ = best_fit_plan(pdf["n"].tolist(), capacity, buffer_size, refill_batch, crop)
        rows = []
        for r, row in enumerate(plan):
            at = 0
            for i, a, b in row:
                rows.append((r, at, i, a, b - a))
                at += b - a
        out = pd.DataFrame(rows, columns=["row_no", "row_at", "i", "a", "tokens"])
        piece = pdf.iloc[out["i"]].reset_index(drop=True)
        return pd.DataFrame({"pack_group": int(pdf["pack_group"].iloc[0]), "row_no": out["row_no"], "row_at": out["row_at"],
                             "ord": piece["ord"], "start": piece["at"] + out["a"], "tokens": out["tokens"]})

    return pieces.groupBy("pack_group").applyInPandas(
        place, f"pack_group bigint, row_no int, row_at int, ord {key_type}, start bigint, tokens bigint")


def char_token_ids(text_col: str = "text", bos_id: int | None = None) -> Column:
    """Codepoint token ids of a text (character-level tokens), optional BOS first."""
    def codepoints(texts):
        import numpy as np
        import pandas as pd
        head = [] if bos_id is None else [bos_id]
        return pd.Series([None if t is None else np.concatenate(
            [np.array(head, dtype="<i4"), np.frombuffer(t.encode("utf-32-le"), dtype="<i4")]) for t in texts], dtype=object)

    return F.pandas_udf(codepoints, "array<int>")(F.col(text_col))


def pack_totals(packed: DataFrame, docs: DataFrame, ids_col: str = "ids", seq_len: int = 2048, pad_id: int = -1,
                size_col: str | None = None) -> DataFrame:
    """One row: tokens that went in, tokens placed (padding not counted), whether all rows are full."""
    real = F.size(F.filter("tokens", lambda t: t != pad_id))
    total = docs.select(F.sum(F.size(ids_col) if size_col is None else F.col(size_col))).scalar()
    return packed.agg(F.coalesce(F.sum(real), F.lit(0)).cast("bigint").alias("tokens_placed"),
                      F.coalesce(F.bool_and(F.size("tokens") == seq_len + 1), F.lit(True)).alias("rows_full")).select(
        F.coalesce(total, F.lit(0)).cast("bigint").alias("tokens_in"), "tokens_placed", "rows_full")
