"""The corpus pipeline: documents in, sampled token pieces out, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import written
from plumbline.llm.mixing import mixed
from plumbline.llm.nearcopies import keep_one
from plumbline.llm.pieces import encode
from plumbline.llm.quality import keep_good
from plumbline.llm.suffixes import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go."""
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has too are cut out."""
    return without_repeats(docs, length="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its budget of words, in whole epochs and a part of one."""
    return mixed(docs, length="n_chars")


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each text, from which it can be decoded without loss."""
    return encode(docs, keep=["doc_id", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("sampled_pieces", sampled_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage gives is written once, the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
