"""Exact deduplication: two-pass Bloom filtering, DataFrame operations only.

Pass one sets, for the hash of every normalised text, two bits in one word of a blocked
Bloom filter and keeps the bits that were set at least twice.  Pass two probes every row:
a row whose bits are not all marked "again" has no equal and passes straight through; the
others (real copies and a few false positives) shuffle on the hash and are grouped.

The text is read once; both passes run on a slim table (id, hash, length).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, text_or_empty, without_spaces

#: Filter words that may be broadcast (16 bytes each); a larger filter is joined by shuffle.
BROADCAST_WORDS = 1 << 20


def repeated_bits(hashes: DataFrame, n_words: int) -> DataFrame:
    """Filter words ``(word, again)``: bits set at least twice. ``hashes``: ``word``, ``bits`` (two bit numbers)."""
    return (hashes.select("word", F.explode("bits").alias("bit"))
            .groupBy("word", "bit").count().where("count >= 2")
            .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("again")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits_per_row: int = 16) -> DataFrame:
    """One row per input row: ``(id, keep_id, group_size, kept, text_sha256, filtered)``.

    Texts are equal when identical without white space (null: empty).  Of equal texts the
    row with the most code points, then the smallest id (nulls last) stays.  Rows that agree
    in id, length and text count separately in ``group_size`` but only one of them is kept.
    ``filtered`` tells that the Bloom filter let the row pass without a shuffle.  Other
    columns are ignored; an empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    slim = cut(docs.select(
        column(id_col).alias("id"),
        F.unhex(F.sha2(without_spaces(text).cast("binary"), 256)).alias("sha"),
        F.length(text).alias("points")))
    n = slim.count()
    n_words = 1 << max(10, (n * bits_per_row // 64).bit_length())
    hashed = slim.withColumn("h", F.xxhash64("sha")).select(
        "id", "sha", "points",
        F.expr(f"h & {n_words - 1}L").alias("word"),
        F.expr("array(cast(shiftrightunsigned(h, 58) as int), cast(shiftrightunsigned(h, 52) & 63 as int))").alias("bits"))
    again = repeated_bits(hashed, n_words)
    if n_words <= BROADCAST_WORDS:
        again = F.broadcast(again)
    mask = F.expr("shiftleft(1L, bits[0]) | shiftleft(1L, bits[1])")
    probed = hashed.join(again, "word", "left").withColumn(
        "maybe", F.coalesce(F.col("again").bitwiseAND(mask) == mask, F.lit(False)))

    single = probed.where("not maybe").select(
        F.col("id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha", F.lit(True).alias("filtered"))

    # Equal rows first become one row with a count, so a hot text shuffles little.
    units = probed.where("maybe").groupBy("sha", "points", "id").agg(F.count("*").alias("copies"))
    best = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("id"))
    # Written out, so that the join below has two plain exchanges and a hot text can be split.
    groups = cut(units.groupBy("sha").agg(F.sum("copies").alias("group_size"), F.min(best).alias("best")))
    stays = (-F.col("points") == F.col("best.p")) & F.col("id").eqNullSafe(F.col("best.id"))
    grouped = (units.join(groups, "sha")
               .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
               .select("id", F.col("best.id").alias("keep_id"), "group_size",
                       (stays & (F.col("nth") == 1)).alias("kept"), "sha", F.lit(False).alias("filtered")))
    return single.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept",
        F.lower(F.hex("sha")).alias("text_sha256"), "filtered")
