"""Whole files and inline content as documents to ingest: (source, content, error)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import payload_kind


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Every file under a path, or the one file, as bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return decoded(reader.load(path).select(F.col("path").alias("source"), "content"))


def inline(spark: SparkSession, rows: list[tuple[str, str | bytes]]) -> DataFrame:
    """(name, text or bytes) pairs."""
    data = [(n, bytearray(c.encode() if isinstance(c, str) else c)) for n, c in rows]
    return decoded(spark.createDataFrame(data, "source string, content binary"))


def decoded(files: DataFrame) -> DataFrame:
    """Adds text, or an error where the bytes aren't UTF-8."""
    kind = payload_kind("content")
    return files.select("source", "content", F.when(kind == "text", F.col("content").cast("string")).alias("text"), F.when(kind != "text", F.lit("not valid UTF-8")).alias("error"))
