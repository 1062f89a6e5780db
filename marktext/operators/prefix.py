"""Running sums over an ordered table of any keys (W1, W5 and everything built on them).

Keys are range-partitioned and written out once; each partition sums on its own, and the
partition totals (one row per partition and group) give the offsets.  Nothing depends on how
dense the keys are, no window sees more than a partition, and only keys move: callers join or
compare back to their wide rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def running_before(keys: DataFrame, order_cols: tuple[str, ...], value: str | None = None,
                   partition_cols: tuple[str, ...] = (), out: str = "before") -> DataFrame:
    """``keys`` plus ``out``: the sum of ``value`` (None: the number of rows) over all earlier
    rows of the group, in the order of ``order_cols`` (together unique within the group)."""
    ensure_checkpoint_dir(keys.sparkSession)
    amount = F.lit(1).cast("bigint") if value is None else F.col(value).cast("bigint")
    # The checkpoint fixes the range bounds: both readers below see the same partitions.
    placed = (keys.repartitionByRange(*partition_cols, *order_cols)
              .withColumn("_p", F.spark_partition_id()).withColumn("_v", amount).checkpoint())
    inside = (Window.partitionBy(*partition_cols, "_p").orderBy(*order_cols)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = placed.groupBy(*partition_cols, "_p").agg(F.sum("_v").alias("_t"))
    # At most one row per partition and group boundary.
    upto = Window.partitionBy(*partition_cols).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(*partition_cols, "_p", (F.sum("_t").over(upto) - F.col("_t")).alias("_o"))
    return (placed.withColumn("_c", F.sum("_v").over(inside)).join(F.broadcast(offsets), [*partition_cols, "_p"])
            .select(*keys.columns, (F.col("_o") + F.col("_c") - F.col("_v")).cast("bigint").alias(out)))


def dense_ordinal(keys: DataFrame, order_col: str = "doc_id", out: str = "ordinal",
                  partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """Dense 0-based rank of ``order_col`` (unique key of any type) within ``partition_cols``."""
    return running_before(keys, (order_col,), None, partition_cols, out)
