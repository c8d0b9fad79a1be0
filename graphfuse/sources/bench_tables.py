"""The driver's tables seen as a graph; each rule has the same words in SQL.

documents become documents and whole-document chunks, embedding labels and
document sources become entities, their meeting on a document and a chain of
sources become relationships.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fusion import Graph

#: Texts of the registered queries, by the label whose vector they carry.
QUERY_TEXTS = ("the", "and the", "that is", "la", "der die", "que de", "en", "of to", "on", "with the")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    meta = F.to_json(F.struct("source", "lang"))
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("namespace"), "source", F.sha2("text", 256).alias("content_hash"), meta.alias("metadata"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    d = documents(spark, sf_dir).select("id", "namespace", F.col("id").alias("document_id"), F.lit(0).alias("ord"), "text", "metadata")
    return d.join(e, "id", "left").select("id", "namespace", "document_id", "ord", "text", "embedding", "metadata")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    labels = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("name_emb"))
    lab = labels.select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("id"), "name_emb")
    src = read(spark, sf_dir, "documents").select(F.concat(F.lit("S"), F.substring("source", 4, 8)).alias("id")).distinct().select("id", F.lit(None).cast("array<float>").alias("name_emb"))
    return lab.unionByName(src).select("id", F.lit("en").alias("namespace"), F.col("id").alias("name"), "name_emb")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("S"), F.substring("source", 4, 8)).alias("entity_id"))
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("entity_id"))
    e = e.join(d.select("doc_id"), "doc_id", "left_semi")
    return d.unionByName(e).select(F.col("doc_id").alias("chunk_id"), "entity_id")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    s = m.filter(F.col("entity_id").startswith("S")).withColumnRenamed("entity_id", "src_id")
    l = m.filter(F.col("entity_id").startswith("L")).withColumnRenamed("entity_id", "dst_id")
    met = s.join(l, "chunk_id").select("src_id", "dst_id", F.lit("has_label").alias("kind")).distinct()
    chain = spark.range(19).select(F.concat(F.lit("S"), F.col("id")).alias("src_id"), F.concat(F.lit("S"), F.col("id") + 1).alias("dst_id"), F.lit("next").alias("kind"))
    return met.unionByName(chain)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(chunks(spark, sf_dir), entities(spark, sf_dir), relationships(spark, sf_dir), mentions(spark, sf_dir))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query a label: its vector, and a text from QUERY_TEXTS."""
    e = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q_emb"))
    texts = F.array(*[F.lit(t) for t in QUERY_TEXTS])
    return e.select(F.col("label").cast("int").alias("query_id"), F.element_at(texts, F.col("label").cast("int") % len(QUERY_TEXTS) + 1).alias("q"), "q_emb", F.lit("en").alias("namespace"))


def row_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedded chunk whose id is divisible by 50, as a query in its namespace."""
    own = chunks(spark, sf_dir).filter((F.col("id") % 50 == 0) & F.col("embedding").isNotNull())
    return own.select(F.col("id").alias("query_id"), F.col("embedding").alias("q_emb"), "namespace")


#: The same tables in DuckDB SQL.
SQL = (
    """
g_documents AS MATERIALIZED (SELECT doc_id AS id, lang AS namespace, source, sha256(text) AS content_hash, text FROM documents),
g_chunks AS MATERIALIZED (SELECT d.id, d.namespace, d.source, d.text, e.embedding::DOUBLE[] AS embedding FROM g_documents d LEFT JOIN embeddings e ON e.vec_id = d.id),
g_labels AS MATERIALIZED (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS emb FROM embeddings GROUP BY 1),
g_entities AS MATERIALIZED (
  SELECT 'L' || label AS id, emb AS name_emb FROM g_labels
  UNION ALL SELECT DISTINCT 'S' || substr(source, 4), NULL FROM documents),
g_mentions AS MATERIALIZED (
  SELECT doc_id AS chunk_id, 'S' || substr(source, 4) AS entity_id FROM documents
  UNION ALL SELECT vec_id, 'L' || label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
g_rel AS MATERIALIZED (
  SELECT DISTINCT s.entity_id AS src, l.entity_id AS dst FROM g_mentions s JOIN g_mentions l USING (chunk_id) WHERE s.entity_id[1] = 'S' AND l.entity_id[1] = 'L'
  UNION ALL SELECT 'S' || i, 'S' || (i + 1) FROM range(19) t(i)),
g_edges AS MATERIALIZED (SELECT src, dst FROM g_rel UNION ALL SELECT dst, src FROM g_rel WHERE src <> dst),
g_queries AS MATERIALIZED (SELECT label::INT AS query_id, (['"""
    + "', '".join(QUERY_TEXTS)
    + """'])[label % 10 + 1] AS q, emb AS q_emb FROM g_labels)"""
)
