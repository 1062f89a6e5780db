"""Corpus pipeline: from documents to encoded training rows, one Parquet table per stage.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktext.llm.common import prepare, read
from marktext.llm.line_dedup import line_dedup
from marktext.llm.mixing import mix_sources
from marktext.llm.quality import quality_filter
from marktext.llm.queries import bpe_digest, tokenizer_path
from marktext.llm.simhash import simhash_dedup
from marktext.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base filter and the decision list learned from ``labels`` keep."""
    prepare(spark)
    return quality_filter(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later places of repeated three-line windows; ``n_chars`` follows the text."""
    prepare(spark)
    out = line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class."""
    prepare(spark)
    return simhash_dedup(docs, shingle=3, bits=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    prepare(spark)
    return mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token number and digests of the encoded and decoded text of every row."""
    prepare(spark)
    return bpe_digest(docs.select("doc_id", "source", "text"), tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mix sources", mix),
    ("bpe encode", encode),
]

#: SimHash and the automaton have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
