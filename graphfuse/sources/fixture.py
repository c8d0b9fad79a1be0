"""JSON lines of an extracted graph: documents, chunks, entities, relationships, mentions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import new_rows
from ..schema import UNIQUE, CoreError

#: Every field of the five kinds; a record has those of its own kind.
FIELDS = (
    "kind string, id string, namespace string, source string, content_hash string, title string, metadata string, document_id string, "
    "ord int, text string, token_count int, embedding array<float>, name string, kind_label string, name_emb array<float>, description string, "
    "src_id string, dst_id string, weight double, chunk_id string, entity_id string, confidence double, classification string, _bad string"
)
KINDS = {"document": "documents", "chunk": "chunks", "entity": "entities", "relationship": "relationships", "chunk_entity": "chunk_entities"}
COLUMNS = {
    "documents": ("id", "namespace", "source", "content_hash", "title", "metadata"),
    "chunks": ("id", "namespace", "document_id", "ord", "text", "token_count", "embedding", "metadata"),
    "entities": ("id", "namespace", "name", "kind", "name_emb", "description"),
    "relationships": ("id", "namespace", "src_id", "dst_id", "kind", "weight"),
    "chunk_entities": ("chunk_id", "entity_id", "confidence", "classification"),
}


def parse(lines: DataFrame, namespace: str | None = None, column: str = "value") -> DataFrame:
    """One row a record with defaults filled in; blank lines drop.  Bad lines keep ``error``.

    An argument namespace overrides the records'.
    """
    rows = lines.filter(F.trim(column) != "").select(F.col(column).alias("line"), F.from_json(column, FIELDS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    kind = F.col("r.kind")
    error = F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "malformed JSON").when(kind.isNull(), "missing kind").when(~kind.isin(*KINDS), F.concat(F.lit("unknown kind "), kind))
    out = rows.select("line", error.alias("error"), "r.*").drop("_bad")
    filled = {"metadata": F.coalesce("metadata", F.lit("{}")), "weight": F.coalesce("weight", F.lit(1.0)), "confidence": F.coalesce("confidence", F.lit(1.0)), "classification": F.coalesce("classification", F.lit("extracted"))}
    if namespace is not None:
        filled["namespace"] = F.lit(namespace)
    return out.withColumns(filled)


def checked(records: DataFrame) -> DataFrame:
    """The records, or an error if any line is bad."""
    bad = records.filter(F.col("error").isNotNull()).select("line", "error").head(1)
    if bad:
        raise CoreError(f"bad record: {bad[0]['error']}: {bad[0]['line'][:200]}")
    return records


def split(records: DataFrame) -> dict[str, DataFrame]:
    """A frame for each kind, with the columns of its table."""
    out = {}
    for kind, table in KINDS.items():
        own = records.filter(F.col("kind") == kind)
        if table in ("entities", "relationships"):
            own = own.drop("kind").withColumnRenamed("kind_label", "kind")
        out[table] = own.select(*COLUMNS[table])
    return out


def load(spark: SparkSession, path: str, stored: dict[str, DataFrame], namespace: str = "default", header: bool = False) -> tuple[int, dict[str, DataFrame]]:
    """(records read, rows to add by table); stored rows and repeats are passed over.

    All or nothing: one bad line fails the load.  header: drop records of kind
    ``_header``, which generators put first.
    """
    records = parse(spark.read.text(path), namespace)
    if header:
        records = records.filter(F.coalesce(F.col("kind") != "_header", F.lit(True)))
    records = checked(records)
    n = records.count()
    parts = split(records)
    order = {t: [F.col(c) for c in COLUMNS[t] if c in ("id", "chunk_id", "entity_id")] for t in parts}
    return n, {t: new_rows(df, stored[t].select(*COLUMNS[t]), UNIQUE[t], order[t]) for t, df in parts.items()}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
