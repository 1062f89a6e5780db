"""Expressions and small helpers shared by the training-data operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: White space of every operator here: space and U+0009 to U+000D.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    return F.coalesce(column(name).cast("string"), F.lit(""))


def without_spaces(text: Column) -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s)), SPACES, text)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; blanks become one character first because
    ``split`` on a single character needs no regular expression."""
    one = reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(" ")), SPACES[1:], text)
    return F.array_remove(F.split(one, " "), "")


def unit_interval(*cols: Column) -> Column:
    """Deterministic uniform number in [0, 1) from a 64-bit hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0 ** -53)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder of ``spark.checkpoint.dir``, so that lost executors
    never replay what lies before and several readers share one computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows in an Arrow batch: texts are long, and a batch is held on both sides of the socket.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package for the Python workers, and Arrow batches of at most ``ARROW_ROWS``."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= ARROW_ROWS:
        spark.conf.set(batch, str(ARROW_ROWS))


def give_back() -> None:
    """At the end of a Python task: an idle worker keeps no freed Arrow memory."""
    import pyarrow as pa
    pa.default_memory_pool().release_unused()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
