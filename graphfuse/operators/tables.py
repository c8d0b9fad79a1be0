"""Writes as set algebra: append without conflict, upsert, cascading delete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: tuple[str, ...], order: list) -> DataFrame:
    """The first row of each key by ``order``; rows with a null in the key all stay."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    w = W.partitionBy(*keys).orderBy(*order)
    one = rows.filter(known).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return one.unionByName(rows.filter(~known))


def new_rows(rows: DataFrame, stored: DataFrame, keys: tuple[str, ...], order: list) -> DataFrame:
    """What ON CONFLICT DO NOTHING would insert: neither stored nor said twice."""
    return first_of(rows, keys, order).join(stored.select(*keys), list(keys), "left_anti")


def anti_append(stored: DataFrame, rows: DataFrame, keys: tuple[str, ...], order: list) -> DataFrame:
    return stored.unionByName(new_rows(rows, stored, keys, order))


def upsert(stored: DataFrame, rows: DataFrame, keys: tuple[str, ...], order: list) -> DataFrame:
    """Rows replace stored ones of the same key; of several the last by ``order`` stays."""
    w = W.partitionBy(*keys).orderBy(F.col("_new").desc(), *[o.desc() if not str(o).endswith(("DESC", "ASC")) else o for o in order])
    both = stored.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Documents go, with their chunks and the mentions of those."""
    gone = ids.select(F.col("id"))
    chunks = tables["chunks"].join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    index = {"postings": tables["postings"].join(chunks, "chunk_id", "left_anti")} if "postings" in tables else {}
    return tables | index | {
        "documents": tables["documents"].join(gone, "id", "left_anti"),
        "chunks": tables["chunks"].join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti"),
        "chunk_entities": tables["chunk_entities"].join(chunks, "chunk_id", "left_anti"),
    }


def delete_namespace(tables: dict[str, DataFrame], name: str, cascade: bool = True) -> dict[str, DataFrame]:
    """A namespace goes, with all its documents, entities, relationships and jobs."""
    ns = F.col("namespace") == name
    if not cascade and not tables["documents"].filter(ns).isEmpty():
        raise ValueError(f"namespace {name!r} isn't empty")
    chunk_ids = tables["chunks"].filter(ns).select(F.col("id").alias("chunk_id"))
    entity_ids = tables["entities"].filter(ns).select(F.col("id").alias("entity_id"))
    out = {t: df.filter(~ns) if "namespace" in df.columns else df for t, df in tables.items()}
    out["chunk_entities"] = tables["chunk_entities"].join(chunk_ids, "chunk_id", "left_anti").join(entity_ids, "entity_id", "left_anti")
    gone = entity_ids.withColumnRenamed("entity_id", "_e")
    rel = out["relationships"]
    out["relationships"] = rel.join(gone, rel.src_id == gone._e, "left_anti").join(gone, rel.dst_id == gone._e, "left_anti")
    if "namespaces" in tables:
        out["namespaces"] = tables["namespaces"].filter(F.col("name") != name)
    return out
