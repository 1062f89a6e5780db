"""Publishing a built corpus (K1, K2) and reading it back.

A version is written to a folder of its own, its row counts are taken from the written files,
and only then a row that names it is appended to the pointer table.  Readers follow the newest
row, so they see the version before or the whole new one; a job that dies leaves a folder that
nothing names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate as V
from ..operators.corpus import DOCS_PER_SHARD
from ..session import ensure_checkpoint_dir
from ..sources.files import scan_condition, scan_manifest
from .writers import write_manifest, write_shards

POINTER_SCHEMA = "number bigint, version string"


def fresh_root(spark: SparkSession) -> str:
    """A new folder in the shared one of the session."""
    return f"{ensure_checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"


def current_version(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """The newest ``(number, version)``; ``(0, None)`` when nothing is published."""
    try:
        rows = spark.read.schema(POINTER_SCHEMA).json(f"{root}/current").orderBy(F.desc("number"), "version").take(1)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return (rows[0]["number"], rows[0]["version"]) if rows else (0, None)


def publish_conditions(shards: DataFrame, manifest: DataFrame, root: str, docs_per_file: int = DOCS_PER_SHARD) -> str:
    """Write one version and point to it; returns its name.

    Raises, and leaves the pointer as it was, if the written files do not hold the manifest's rows.
    """
    spark = shards.sparkSession
    version = uuid.uuid4().hex
    folder = f"{root}/{version}"
    write_shards(shards, f"{folder}/shards", docs_per_file=docs_per_file)
    write_manifest(manifest, f"{folder}/manifest")
    # One row per condition.
    checks = V.row_count_matches(scan_condition(spark, f"{folder}/shards"), scan_manifest(spark, f"{folder}/manifest")).collect()
    wrong = [f"{r['condition']}: {r['detail']}" for r in checks if not r["passed"]]
    if wrong:
        raise ValueError(f"written rows differ from the manifest: {wrong}")
    number = current_version(spark, root)[0] + 1
    (spark.range(1).select(F.lit(number).cast("bigint").alias("number"), F.lit(version).alias("version"))
     .coalesce(1).write.mode("append").json(f"{root}/current"))
    return version


def read_published(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Shards and manifest of the newest version."""
    _, version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return scan_condition(spark, f"{root}/{version}/shards"), scan_manifest(spark, f"{root}/{version}/manifest")
