"""Line deduplication over overlapping three-line windows, DataFrame operations only.

Every run of three consecutive non-blank lines of a document is hashed (128 bits).  A window
found at two places or more repeats; all its places but the first, in the order of document id
and line, cover their three lines, and covered lines go.  Windows shuffle as hashes; the text
itself moves once, to meet its covered positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, column, cut, text_or_empty

_BLANK = "".join(SPACES)


def _numbered(lines: F.Column) -> F.Column:
    """Numbers of the non-blank lines, in order."""
    return F.filter(F.transform(lines, lambda line, i: F.when(F.btrim(line, F.lit(_BLANK)) != "", i)),
                    lambda i: i.isNotNull())


def line_windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, version, at, h1, h2)``: each window of ``width`` non-blank lines by its first line's rank."""
    text = text_or_empty(text_col)
    rows = docs.select(column(id_col).alias("id"), F.xxhash64(text).alias("version"),
                       F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_BLANK)) != "").alias("lines"))

    def window(at):
        parts = [F.get("lines", at + k) for k in range(width)]
        return F.struct(at.alias("at"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))

    return (rows.where(F.size("lines") >= width)
            .select("id", "version", F.explode(F.transform(
                F.sequence(F.lit(0), F.size("lines") - width), window)).alias("w"))
            .select("id", "version", "w.*"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with repeated passages removed from the text, plus ``n_lines`` (non-blank lines
    found) and ``n_removed``.

    Lines compare exactly; blank lines (white space only) neither count nor go.  Documents of
    fewer than ``width`` non-blank lines stay as they are.  The first place of a window is the
    one with the smallest id (nulls last), then text hash, then line.  Rows that agree in id
    and text are one document: they are treated alike and are no repetition of each other.
    A line's content never vanishes from the corpus: its earliest place stays.  Null texts stay
    null.  An empty table gives an empty result; columns of ``docs`` named like the two added ones
    are replaced.
    """
    windows = cut(line_windows(docs, id_col, text_col, width))
    place = F.struct(F.col("id").isNull().alias("n"), "id", "version", "at")
    # Written out, so that the join below has two plain exchanges and a very common window can be split.
    repeated = cut(windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                   .where("first < last").drop("last"))
    later = windows.join(repeated, ["h1", "h2"]).where(place > F.col("first"))
    covered = later.groupBy(F.col("id").alias("_id"), F.col("version").alias("_version")).agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + width - 1)))).alias("_covered"))

    # The row travels as one struct, so no name of the table can clash with one used here.
    text = text_or_empty(text_col)
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(id_col).alias("id"),
                       F.xxhash64(text).alias("key"))
    own = F.col("row").getField(text_col)
    met = (rows.join(covered.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_version")), "left")
           .withColumn("lines", F.split(F.coalesce(own, F.lit("")), "\n"))
           .withColumn("ranks", _numbered(F.col("lines"))))
    gone = F.transform(F.col("_covered"), lambda r: F.get(F.col("ranks"), r))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    new = F.when(F.col("_covered").isNull(), own).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    counts = {"n_lines": F.size("ranks").cast("long"), "n_removed": F.coalesce(F.size("_covered"), F.lit(0)).cast("long")}
    return met.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in counts],
                      *[v.alias(k) for k, v in counts.items()])
