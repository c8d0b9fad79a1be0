"""Corpus pipeline: from raw documents to packed training sequences.

Five stages, each one operator of ``graphfuse.llm`` applied to all that the
stage before it kept.  A stage takes (spark, docs, sf_dir) and returns a frame;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfuse.llm import decontaminate, near_dup, packing, quality_rules, repeats
from graphfuse.llm.cluster import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules or the perplexity band reject go; rows stay where they are."""
    kept = quality_rules.quality_rules(docs, with_rows=True).filter("kept")
    return kept.select(*[F.col(f"own.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each linked group stays, a repeated row once.

    Rows without an id stay where one of them is its group's smallest.
    """
    ids = near_dup.near_duplicates(docs).filter("kept").select("doc_id")
    ids = Scratch(spark, "kept").save(ids.distinct(), "ids")
    known = docs.filter("doc_id is not null").join(ids, "doc_id", "left_semi")
    if not ids.filter("doc_id is null").isEmpty():
        known = known.unionByName(docs.filter("doc_id is null"))
    return known.select(*docs.columns).dropDuplicates(["doc_id", "text"])


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand elsewhere too are cut out of the texts."""
    cut = repeats.remove_repeats(docs, with_text=True)
    back = {c: F.col(f"own.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept_text")}
    if "n_chars" in back:
        back["n_chars"] = F.length("kept_text").cast("long")
    return cut.select(*[back[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or with few edits, go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is laid out in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: No SQL can express the model-based and tokenising stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
