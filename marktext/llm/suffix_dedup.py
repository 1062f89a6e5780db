"""Removal of long repeated byte strings: suffix intervals of a Burrows-Wheeler transform.

A suffix array of the whole corpus would be one task's work, so the corpus is first dealt into
small pieces that cannot miss a repetition.  Every window of ``length`` bytes is named by its
minimizer (the substring of ``kmer`` bytes with the smallest hash, leftmost on ties); neighbouring
windows with one minimizer form a segment, and equal windows have equal minimizers, so segments
with the same minimizer meet in a bucket.  Minimizers that occur once are dropped.  Equal segments
are one row with a count.  A bucket of one segment repeats as a whole if the segment was met twice;
for the others a batch of buckets is sorted into a Burrows-Wheeler transform, and breadth-first
backward extension sets common prefixes by increasing value up to ``length - 1``: neighbours in
suffix order whose common prefix is still open share ``length`` bytes.

A bucket of too many different segments (a passage with very many variants) is dealt again by a
longer substring, at last by the window itself, so no bucket is sorted whole whatever its size.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import column, give_back, text_or_empty

LENGTH = 200
#: Lengths of the minimizer, relative to the window, each for the buckets too large for the one before.
KMERS = (0.24, 0.6, 0.85, 1.0)
#: Bytes of different segments that one bucket may hold, and that one transform takes.
BUCKET_BYTES = 1 << 20
BATCH_BYTES = 1 << 19
#: Positions hashed at a time.
CHUNK = 1 << 20
#: Most bits of the filter of repeated hashes that is broadcast.
FILTER_BITS = 29

_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 21) - 1)


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
    x ^= x >> np.uint64(29)
    return x


class Segments:
    """Segments of the windows of many texts; the powers of the rolling hash are kept."""

    def __init__(self, length: int, kmer: int):
        self.length, self.kmer = length, kmer
        size = CHUNK + length
        power, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        self.power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(text number, first window, number of windows, minimizer, content hash)`` per segment."""
        found = [self._chunk(data, offsets, c) for c in range(0, len(data), CHUNK)]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(5))

    def _chunk(self, data, offsets, c0):
        length, kmer = self.length, self.kmer
        piece = data[c0:c0 + CHUNK + length - 1]
        m = len(piece)
        if m < length:
            return (np.zeros(0, np.int64),) * 5
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * self.power[:m], out=sums[1:])
        hashed = _mixed((sums[kmer:] - sums[:m - kmer + 1]) * self.inverse[:m - kmer + 1], 0xD6E8FEB86659FD93)
        least = (hashed & ~_LOW) | np.arange(len(hashed), dtype=np.uint64)
        width, span = length - kmer + 1, 1
        while span * 2 <= width:                       # least over spans of 1, 2, 4, ... positions
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[:-(width - span)], least[width - span:])
        at = (least & _LOW).astype(np.int64)
        # Windows that lie in one text: +1 where a text's first starts, -1 after its last.
        lo, hi = offsets[:-1] - c0, offsets[1:] - c0 - length + 1
        own = hi > lo
        edge = np.zeros(len(at) + 1, np.int32)
        np.add.at(edge, np.clip(lo[own], 0, len(at)), 1)
        np.add.at(edge, np.clip(hi[own], 0, len(at)), -1)
        valid = np.cumsum(edge[:-1]) > 0
        same = valid[1:] & valid[:-1] & (at[1:] == at[:-1])
        first = np.flatnonzero(valid & ~np.concatenate(([False], same)))
        last = np.flatnonzero(valid & ~np.concatenate((same, [False])))
        text = np.searchsorted(offsets, first + c0, "right") - 1
        windows = last - first + 1
        content = (sums[last + length] - sums[first]) * self.inverse[first]
        content = _mixed(content + (windows.astype(np.uint64) << np.uint64(40)), 0xCA5A826395121157)
        return (text, first + c0 - offsets[text], windows,
                _mixed(hashed[at[first]] * np.uint64(0xFF51AFD7ED558CCD), 0xC4CEB9FE1A85EC53).view(np.int64), content.view(np.int64))


def _flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary array, without a copy of the bytes."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` symbols (at least), by doubling."""
    n = len(symbols)
    after = np.concatenate((symbols, np.zeros(depth + 4, symbols.dtype))).astype(np.uint64)
    if int(symbols.max()) < 1 << 16:
        key, known = after[:n] << np.uint64(48) | after[1:n + 1] << np.uint64(32) | after[2:n + 2] << np.uint64(16) | after[3:n + 3], 4
    else:
        key, known = after[:n], 1
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, np.uint64)
        ranked = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1]))).astype(np.uint64)
        if known >= depth or int(rank[order[-1]]) == n - 1:
            return order
        shifted = np.zeros(n, np.uint64)
        shifted[:max(0, n - known)] = rank[known:]
        key, known = rank << np.uint64(32) | shifted, known * 2


def repeated_starts(texts: list[bytes], length: int) -> np.ndarray:
    """Whether the string of ``length`` bytes from each position of the joined texts (each followed
    by one separator) starts at another position too; strings that reach a separator do not count.
    """
    m = len(texts)
    symbols = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + m, k) for k, t in enumerate(texts)])
    n = len(symbols)
    order = suffix_order(symbols, length)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    keyed = bwt[by_symbol] * (n + 1) + by_symbol       # ascending: backward steps are searches in it
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)

    first = symbols[order]
    bounds = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1], [True])))
    low, high = bounds[:-1], bounds[1:]
    known = np.zeros(n + 1, bool)                      # whether the common prefix of rows i - 1 and i is below the level
    known[bounds] = True
    for _ in range(1, length):
        size = high - low
        one = size == 1
        rows = low[one][bwt[low[one]] >= m]
        ends = step[rows] + 1
        low1 = ends[~known[ends]] - 1
        wide_low, wide_high, wide = low[~one], high[~one], size[~one]
        owner = np.repeat(np.arange(len(wide)), wide)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(wide) - wide, wide) + wide_low[owner]
        pairs = np.unique(owner * (m + 256) + bwt[inside])
        owner, symbol = np.divmod(pairs, m + 256)
        owner, symbol = owner[symbol >= m], symbol[symbol >= m]
        new_low = np.searchsorted(keyed, symbol * (n + 1) + wide_low[owner])
        new_high = np.searchsorted(keyed, symbol * (n + 1) + wide_high[owner])
        open_ = ~known[new_high]
        low, high = np.concatenate((low1, new_low[open_])), np.concatenate((low1 + 1, new_high[open_]))
        known[high] = True
        if not len(low):
            break
    shared = np.flatnonzero(~known)
    out = np.zeros(n, bool)
    out[order[shared]] = True
    out[order[shared - 1]] = True
    return out


def _runs(marks: np.ndarray) -> np.ndarray:
    """``[start, stop)`` of every run of true values."""
    edges = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)), axis=1)


def _written(df: DataFrame) -> DataFrame:
    """Cut lineage with a compressed table in the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/suffix-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _bitmap(hashes: DataFrame, count: int):
    """Filter of hashes as 64-bit words, broadcast; at most ``2 ** FILTER_BITS`` bits.  What it lets
    through besides only costs a row: the grouping after it is exact."""
    bits = min(FILTER_BITS, max(12, (16 * count).bit_length()))
    words = (hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("p"))
             .groupBy(F.shiftrightunsigned("p", 6).alias("w"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow())
    filled = np.zeros(1 << (bits - 6), np.uint64)
    filled[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast((bits, filled))


def _passes(filter_, hashes: np.ndarray) -> np.ndarray:
    bits, filled = filter_.value
    at = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return (filled[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def repeated_windows(texts: DataFrame, length: int = LENGTH, kmers: tuple[int, ...] | None = None,
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(id, version, start, stop)``: windows of ``length`` bytes from offsets ``start`` to
    ``stop - 1`` that start elsewhere too, in another text or the same.

    ``texts``: ``id``, ``version``, ``copies`` (long: how many equal texts the row stands for) and
    ``text`` (binary).  Ranges may touch; every repeated window lies in one, and no other window.
    """
    kmers = kmers or tuple(max(1, round(length * k)) for k in KMERS)
    kmer = kmers[0]
    id_type = texts.schema["id"].dataType.simpleString()

    def count(batches):
        import pyarrow as pa
        cutter = Segments(length, kmer)
        for b in batches:
            text, _, _, mini, _ = cutter.of(*_flat(b.column("text")))
            found, inverse = np.unique(mini, return_inverse=True)
            n = np.bincount(inverse, weights=b.column("copies").to_numpy()[text], minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"h": found, "n": n})
        give_back()

    repeated = _written(texts.select("copies", "text").mapInArrow(count, "h long, n long")
                        .groupBy("h").agg(F.sum("n").alias("n")).where("n >= 2").select("h"))
    minis = _bitmap(repeated, repeated.count())

    def place(batches):
        import pyarrow as pa
        cutter = Segments(length, kmer)
        for b in batches:
            text, at, windows, mini, content = cutter.of(*_flat(b.column("text")))
            keep = _passes(minis, mini)
            rows = pa.array(text[keep])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(rows) for c in ("id", "version", "copies")), pa.array(at[keep]), pa.array(windows[keep]),
                 pa.array(mini[keep]), pa.array(content[keep])], ["id", "version", "copies", "at", "windows", "mini", "content"])
        give_back()

    places = _written(texts.select("id", "version", "copies", "text").mapInArrow(
        place, f"id {id_type}, version long, copies long, at long, windows long, mini long, content long"))
    segments = places.groupBy("mini", "content").agg(F.sum("copies").alias("copies"), F.max("windows").alias("windows"))
    buckets = segments.groupBy("mini").agg(F.sum("copies").alias("total"), F.count("*").alias("different")).where("total >= 2")
    # Written out, so that the joins below have two plain exchanges and a hot bucket can be split.
    met = _written(segments.join(buckets.drop("total"), "mini"))
    whole = met.where("copies >= 2").select("mini", "content", F.lit(0).cast("long").alias("start"), F.col("windows").alias("stop"))
    mixed = met.where("different >= 2")
    n_mixed = mixed.count()
    if not n_mixed:
        return _ranges(places, whole)

    wanted = _bitmap(mixed.select((F.col("mini").bitwiseXOR(F.col("content"))).alias("h")), n_mixed)

    def fetch(batches):
        import pyarrow as pa
        cutter = Segments(length, kmer)
        for b in batches:
            data, offsets = _flat(b.column("text"))
            text, at, windows, mini, content = cutter.of(data, offsets)
            keep = np.flatnonzero(_passes(wanted, mini ^ content))
            _, once = np.unique(np.stack((mini[keep], content[keep])), axis=1, return_index=True) if len(keep) else (0, keep)
            keep = keep[once]
            from_ = offsets[text[keep]] + at[keep]
            yield pa.RecordBatch.from_pydict({"mini": mini[keep], "content": content[keep], "text": pa.array(
                [data[a:z].tobytes() for a, z in zip(from_, from_ + windows[keep] + length - 1)], pa.binary())})
        give_back()

    fetched = (texts.select("text").mapInArrow(fetch, "mini long, content long, text binary")
               .groupBy("mini", "content").agg(F.any_value("text").alias("text")).join(mixed, ["mini", "content"]))
    large = F.lit(len(kmers) > 1) & (F.col("different") * (length + (length - kmer) // 2) > bucket_bytes)
    some_large = not mixed.where(large).isEmpty()
    if some_large:
        fetched = _written(fetched)

    def sort(batches):
        import pyarrow as pa
        group, ready, held = [], [], 0

        def settle():
            marks, at = repeated_starts([g[2] for g in ready], length), 0
            rows = []
            for mini, content, text in ready:
                rows += [(mini, content, int(a), int(z)) for a, z in _runs(marks[at:at + len(text) - length + 1])]
                at += len(text) + 1
            return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], pa.int64())
                                               for i, k in enumerate(("mini", "content", "start", "stop"))})

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("mini", "content", "text"))):
                if group and group[0][0] != row[0]:       # buckets stay whole, several share a transform
                    ready, held, group = ready + group, held + sum(len(g[2]) for g in group), []
                    if held >= BATCH_BYTES:
                        yield settle()
                        ready, held = [], 0
                group.append(row)
        ready = ready + group
        if ready:
            yield settle()
        give_back()

    sorted_ = (fetched.where(~large).select("mini", "content", "text").repartition("mini").sortWithinPartitions("mini")
               .mapInArrow(sort, "mini long, content long, start long, stop long"))
    results = whole.unionByName(sorted_)
    if some_large:
        deeper = repeated_windows(fetched.where(large).select(F.col("mini").alias("id"), F.col("content").alias("version"),
                                                              "copies", "text"), length, kmers[1:], bucket_bytes)
        results = results.unionByName(deeper.select(F.col("id").alias("mini"), F.col("version").alias("content"), "start", "stop"))
    return _ranges(places, results)


def _ranges(places: DataFrame, results: DataFrame) -> DataFrame:
    """Results of segments at all their places."""
    results = _written(results)
    return places.select("id", "version", "at", "mini", "content").join(results, ["mini", "content"]).select(
        "id", "version", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("stop")).alias("stop"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 kmers: tuple[int, ...] | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(id, kept, n_bytes, n_removed, n_spans, spans)`` for every row: the text as UTF-8 bytes without
    those covered by a string of ``length`` bytes that also starts anywhere else.

    Strings are judged on the input, across and within texts, overlaps included, never across the end
    of a text.  Repeated rows count as different texts, so they remove each other.  ``spans`` are the
    maximal removed runs as ``start, stop`` byte offsets; ``kept`` is binary because a span may end
    inside a character.  A null text is empty; ids may be null or equal; other columns are ignored;
    an empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    rows = docs.select(column(id_col).alias("id"), F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))
    found = repeated_windows(rows.withColumn("copies", F.lit(1).cast("long")), length, kmers, bucket_bytes)
    # Rows that agree in id and text have the same ranges: each of them is given every range once.
    by_text = found.groupBy(F.col("id").alias("_id"), F.col("version").alias("_version")).agg(
        F.collect_set(F.struct("start", "stop")).alias("ranges"))
    met = rows.join(by_text.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")

    def remove(batches):
        import pyarrow as pa
        for b in batches:
            kept, spans = [], []
            for t, found in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist()):
                merged = []
                for r in sorted((r["start"], r["stop"] + length - 1) for r in found or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                ends = [0, *(z for _, z in merged)]
                kept.append(b"".join(t[a:z] for a, z in zip(ends, [*(a for a, _ in merged), len(t)])))
                spans.append([{"start": a, "stop": z} for a, z in merged])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(t) for t in b.column("text").to_pylist()], pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                ["id", "n_bytes", "kept", "spans"])
        give_back()

    out = met.select("id", "text", "ranges").mapInArrow(
        remove, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>")
    return out.select("id", "kept", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), "spans")
