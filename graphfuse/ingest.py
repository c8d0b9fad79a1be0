"""Batch ingest: documents to chunks, vectors, entities and their links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import stable_uuid
from .functions.vector import hash_embed
from .operators.chunking import chunk, chunk_errors
from .operators.resolve import canonical, merge_decision
from .operators.tables import first_of, new_rows
from .providers import Mock, Provider
from .schema import Settings
from .session import cut


def new_documents(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose (namespace, content) isn't stored, the first of each by order.

    sources: (namespace, source, text, seq); rows with an error are left out.
    """
    docs = sources.withColumn("content_hash", F.sha2(F.encode("text", "UTF-8"), 256))
    return new_rows(docs, stored, ("namespace", "content_hash"), [F.col("seq")]).withColumn("id", stable_uuid("namespace", "content_hash"))


def extract(chunks: DataFrame, provider: Provider) -> DataFrame:
    """(chunk_id, what, position, name, kind, description, confidence, dst, weight) rows of each chunk."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for cid, text in zip(pdf["id"], pdf["text"], strict=True):
                got = provider.extract(text)
                rows += [(cid, "entity", i, e["name"], e["kind"], e["description"], e["confidence"], None, None) for i, e in enumerate(got.entities)]
                rows += [(cid, "relationship", i, r["src"], r["kind"], None, None, r["dst"], r["weight"]) for i, r in enumerate(got.relationships)]
            yield pd.DataFrame(rows, columns=["chunk_id", "what", "position", "name", "kind", "description", "confidence", "dst", "weight"])

    return chunks.select("id", "text").mapInPandas(run, "chunk_id string, what string, position int, name string, kind string, description string, confidence double, dst string, weight double")


def link(found: DataFrame, ids: DataFrame, namespace: DataFrame) -> DataFrame:
    """Relationships between entities that the same chunk lists; others drop.

    ids: (chunk_id, name, entity_id).
    """
    rel = found.filter("what = 'relationship'").select("chunk_id", F.col("name").alias("src"), "dst", "kind", "weight", "position")
    a = ids.select("chunk_id", F.col("name").alias("src"), F.col("entity_id").alias("src_id"))
    b = ids.select("chunk_id", F.col("name").alias("dst"), F.col("entity_id").alias("dst_id"))
    return rel.join(a, ["chunk_id", "src"]).join(b, ["chunk_id", "dst"]).join(namespace, "chunk_id")


def plan(spark: SparkSession, sources: DataFrame, tables: dict[str, DataFrame], strategy: str = "auto", provider: Provider | None = None, settings: Settings = Settings(), save=cut, embed: Callable[[str], Column] | None = None) -> dict[str, DataFrame]:
    """Rows that an ingest of ``sources`` adds to each table.

    embed: the vector of a text column, by default the hash embedding.  A document
    that no chunk comes from is not added; ``empty`` lists those (namespace,
    source, content_hash).

    Nothing is written here: the caller commits all tables in one step, so a
    failure anywhere leaves the store as it was.
    """
    provider = provider or Mock()
    embed = embed or (lambda c: hash_embed(c, settings.embed_dim))
    docs = save(new_documents(sources.filter("text is not null"), tables["documents"].select("namespace", "content_hash")))
    parts = chunk(docs.select(F.col("id").alias("document_id"), "text"), strategy)
    about = docs.select(F.col("id").alias("document_id"), "namespace", "seq")
    chunks = parts.join(about, "document_id").withColumn("id", stable_uuid("document_id", "ord")).withColumn("embedding", embed("text")).withColumn("metadata", F.lit("{}"))
    chunks = save(chunks)
    none = chunk_errors(docs.select(F.col("id").alias("document_id")), chunks).select(F.col("document_id").alias("id"))
    empty = save(docs.join(none, "id", "left_semi").select("id", "namespace", "source", "content_hash"))
    docs = docs.join(empty.select("id"), "id", "left_anti")
    found = save(extract(chunks.repartition(settings.extract_concurrency), provider))
    place = chunks.select(F.col("id").alias("chunk_id"), "namespace", "seq", "ord")
    ents = found.filter("what = 'entity'").join(place, "chunk_id")
    named = ents.withColumn("key", F.struct("seq", "ord", "position"))
    # the first mention of a name stands for its later ones
    firsts = named.groupBy("namespace", "name").agg(F.min("key").alias("key"), F.min_by("kind", "key").alias("kind"), F.min_by("description", "key").alias("description"))
    firsts = save(firsts.select("namespace", "name", "kind", "description", stable_uuid("namespace", "name").alias("id"), embed("name").alias("name_emb"), "key"))
    known = merge_decision(firsts, tables["entities"].filter("name_emb is not null"))
    fresh = firsts.join(known.filter("entity_id is null").select(F.col("mention_id").alias("id")), "id", "left_semi")
    order = fresh.select("namespace", "id", "name", "name_emb", F.concat_ws(" ", F.lpad(F.col("key.seq").cast("string"), 12, "0"), F.lpad(F.col("key.ord").cast("string"), 9, "0"), F.lpad(F.col("key.position").cast("string"), 9, "0"), "id").alias("rank"))
    leaders = canonical(order.select(F.concat_ws(" ", "namespace", "rank").alias("id"), "name", "name_emb"), save=save)
    own = order.select(F.concat_ws(" ", "namespace", "rank").alias("r"), F.col("id").alias("entity"))
    led = leaders.join(own, leaders.id == own.r).select(F.col("entity").alias("mention_id"), "canonical").join(own.select(F.col("r").alias("canonical"), F.col("entity").alias("entity_id")), "canonical").select("mention_id", "entity_id")
    ids = known.filter("entity_id is not null").unionByName(led)
    by_name = firsts.select(F.col("id").alias("mention_id"), "namespace", "name").join(ids, "mention_id").select("namespace", "name", "entity_id")
    in_chunk = save(ents.join(by_name, ["namespace", "name"]).select("chunk_id", "name", "entity_id", "confidence", "position"))
    added = fresh.join(led.select("entity_id").distinct().withColumnRenamed("entity_id", "id"), "id", "left_semi")
    links = link(found, in_chunk.select("chunk_id", "name", "entity_id").distinct(), place.select("chunk_id", "namespace"))
    rel = links.select(stable_uuid("namespace", "src_id", "dst_id", "kind").alias("id"), "namespace", "src_id", "dst_id", "kind", "weight", "chunk_id", "position")
    return {
        "empty": empty.drop("id"),
        "documents": docs.select("id", "namespace", "source", "content_hash", F.lit("{}").alias("metadata"), F.current_timestamp().alias("ingested_at")),
        "chunks": chunks.select("id", "namespace", "document_id", "ord", "text", "token_count", "embedding", "metadata"),
        "entities": added.select("id", "namespace", "name", "kind", "name_emb", "description", F.lit("{}").alias("properties")),
        "relationships": new_rows(rel, tables["relationships"], ("namespace", "src_id", "dst_id", "kind"), [F.col("chunk_id"), F.col("position")]).drop("chunk_id", "position"),
        "chunk_entities": first_of(in_chunk, ("chunk_id", "entity_id"), [F.col("position")]).select("chunk_id", "entity_id", "confidence", F.lit("extracted").alias("classification")),
    }
