"""SimHash near-duplicates with pivot distance tables.

1. Fingerprints: 64 majority bits over the XXH64 of every word shingle (Arrow batches, numpy).
2. Pivot table: for each distinct fingerprint its Hamming distances to ``N_PIVOTS`` reference
   fingerprints.  By the triangle inequality the distances of two fingerprints within r bits
   differ by at most r at every pivot; a pair with a larger difference anywhere is discarded.
3. Pairs meet in buckets.  Cut into four 16-bit blocks, fingerprints within two bits agree in
   two blocks at least, so they share one of six 32-bit keys; random fingerprints rarely do.
   Within a bucket the pivot table discards pairs and the survivors are verified bit by bit.
4. A crowded bucket (many near copies of one text) would pair quadratically.  Its members use
   references from the data instead: x and y are within two bits exactly if some reference
   lies within one bit of both, so every member names the 65 references within one bit of it
   and members that name the same one are linked to the smallest.  This is exact and linear.
5. Links are contracted to components; a class is named by its smallest document id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, cut, give_back, text_or_empty
from .components import connected_components

N_PIVOTS = 16
#: Buckets of more fingerprints are linked through common references instead of in pairs.
CROWDED = 32


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of one text as an unsigned 64-bit integer; 0 for a text without words."""
    # bytes.lower() changes A-Z only and bytes.split() knows exactly the white space meant.
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    line, n = b" ".join(found), max(1, len(found) - shingle + 1)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts, stops = [0, *ends[:n - 1]], ends[min(shingle, len(found)) - 1:]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):  # bounded memory on very long texts
        h = np.array([digest(line[a:b - 1], 42) for a, b in zip(starts[at:at + (1 << 15)], stops[at:at + (1 << 15)])],
                     dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, row: bool = False) -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long; with ``row`` also the whole row as a struct."""
    whole = [F.struct(*[column(c) for c in docs.columns]).alias("row")] if row else []
    rows = docs.select(column(id_col).alias("id"), *whole, text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(b.num_columns - 1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))],
                                             names=[*b.schema.names[:-1], "fp"])
        give_back()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def pivot_table(fps: DataFrame, n_pivots: int = N_PIVOTS) -> DataFrame:
    """Adds ``pivots``: Hamming distances to fixed pseudo-random references."""
    refs = [xxhash.xxh64_intdigest(f"pivot {i}".encode(), 42) for i in range(n_pivots)]
    signed = [r - (1 << 64) if r >> 63 else r for r in refs]
    return fps.withColumn("pivots", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("byte") for r in signed]))


def _bucket_keys(fp: F.Column) -> F.Column:
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return F.array(*[F.struct(F.lit(k).alias("pair"), F.shiftleft(block[i], 16).bitwiseOR(block[j]).alias("key"))
                     for k, (i, j) in enumerate(combinations(range(4), 2))])


def fingerprint_links(fps: DataFrame, bits: int = 2, crowded: int = CROWDED, n_pivots: int = N_PIVOTS) -> DataFrame:
    """Links ``(a, b)`` that connect every two distinct ``fp`` within ``bits`` (at most 2) bits."""
    if not 0 <= bits <= 2:
        raise ValueError("the four-block buckets hold for up to two bits")
    keyed = cut(pivot_table(fps, n_pivots).withColumn("k", F.explode(_bucket_keys(F.col("fp")))).select("k.*", "fp", "pivots"))
    shared = cut(keyed.groupBy("pair", "key").agg(F.count("*").alias("n")).where("n > 1"))
    small = cut(keyed.join(shared.where(F.col("n") <= crowded), ["pair", "key"]))
    x = small.select("pair", "key", F.col("fp").alias("a"), F.col("pivots").alias("pa"))
    y = small.select("pair", "key", F.col("fp").alias("b"), F.col("pivots").alias("pb"))
    near = reduce(lambda c, i: c & (F.abs(F.col("pa")[i] - F.col("pb")[i]) <= bits), range(n_pivots), F.lit(True))
    paired = x.join(y, (x["pair"] == y["pair"]) & (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & near
                    & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")

    # Distance one or two through a common reference; with bits = 1 the member itself is one end.
    crowd = keyed.join(shared.where(F.col("n") > crowded), ["pair", "key"]).select("fp").distinct()
    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63))) for i in range(64)]]
    named = cut(crowd.select("fp", F.explode(F.array(*flips)).alias("ref"))) if bits else None
    if named is None:
        return paired
    if bits == 1:
        linked = named.select(F.col("fp").alias("a"), F.col("ref").alias("b")).join(
            crowd.select(F.col("fp").alias("b")), "b", "left_semi").where("a < b")
    else:
        least = cut(named.groupBy("ref").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").drop("top"))
        linked = named.join(least, "ref").where("a <> fp").select("a", F.col("fp").alias("b"))
    return paired.unionByName(linked.select("a", "b"))


def _classes(rows: DataFrame, bits: int) -> DataFrame:
    """``(fp, root)`` and of each class the first id and its fingerprint, for ``rows (id, fp)``."""
    first = F.struct(F.col("id").isNull().alias("n"), "id", "fp")
    # Copies share a fingerprint: one row for each distinct one from here on.
    fps = cut(rows.groupBy("fp").agg(F.min(first).alias("first")))
    roots = connected_components(fingerprint_links(fps.select("fp"), bits))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    classes = named.groupBy("root").agg(F.min("first").alias("first"))
    return named.select("fp", "root").join(classes, "root")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                  bits: int = 2) -> DataFrame:
    """One row of each class, same columns: the one with the smallest id (nulls last); of rows
    that share id and fingerprint the smallest in the order of their columns."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    stays = cut(_classes(rows, bits).select("first").distinct().select(
        F.col("first.id").alias("_id"), F.col("first.fp").alias("_fp")))
    tagged = fingerprints(docs, id_col, text_col, shingle, row=True)
    kept = tagged.join(stays.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")))
    return kept.groupBy("_id", "_fp").agg(F.min("row").alias("row")).select("row.*")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    bits: int = 2) -> DataFrame:
    """One row per input row: ``(id, fp, component_id)``.

    ``component_id`` is the smallest id (nulls last) among all documents reachable over links of
    at most ``bits`` differing bits.  Null and wordless texts have fingerprint zero and link like
    any other; repeated rows are returned as often as they come.  No rows, no result rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    table = cut(_classes(rows, bits).select("fp", F.col("first.id").alias("component_id")))
    return rows.join(table, "fp").select("id", "fp", "component_id")
