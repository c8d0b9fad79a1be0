"""The three ranked lanes of retrieval, for a batch of queries at once.

Queries are a frame (query_id, q, q_emb, namespace).  A lane returns
(query_id, chunk_id, rk), at most ``limit`` rows a query, ranked with the chunk
id as the last key.  Lanes carry ids only; texts are joined after the fusion.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.jsonx import json_contains
from ..functions.text import simple_tokens
from ..functions.vector import cosine_distance
from ..schema import LANE_LIMIT, SEED_DISTANCE, SEED_LIMIT
from ..session import cut

#: Queries whose vectors go to the tasks at once; larger batches take several passes.
QUERY_BLOCK = 2_000
#: Query words up to which a stored index is scanned with a pushed-down list.
MOST_WORDS = 1_000


def ranked(rows: DataFrame, order: list[Column], limit: int, key: str = "chunk_id") -> DataFrame:
    w = W.partitionBy("query_id").orderBy(*order, F.col(key).asc())
    return rows.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= limit)


def _against(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows with each query of their namespace.

    Queries are a stated set: they are counted, and sent to the tasks in blocks
    of about QUERY_BLOCK, one pass over the rows a block.
    """
    q = queries.select("query_id", "q_emb", "namespace")
    n = -(-q.count() // QUERY_BLOCK) or 1
    parts = [q] if n == 1 else [q.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) for k in range(n)]
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(p), "namespace") for p in parts])


def allowed(chunks: DataFrame, metadata_filter: str | dict | None) -> DataFrame:
    """The filter stands inside every lane, before its limit."""
    return chunks if metadata_filter is None else chunks.filter(json_contains("metadata", metadata_filter))


def vector_lane(chunks: DataFrame, queries: DataFrame, metadata_filter: str | dict | None = None, limit: int = LANE_LIMIT) -> DataFrame:
    """Nearest chunks by cosine distance; chunks without an embedding come last.

    Row-wise form for a few queries: one join on the namespace, the distance in
    generated code, top rows by a group limit ahead of the shuffle.
    """
    c = allowed(chunks, metadata_filter).select(F.col("id").alias("chunk_id"), "namespace", "embedding")
    pairs = _against(c, queries)
    d = pairs.select("query_id", "chunk_id", cosine_distance("embedding", "q_emb").alias("distance"))
    return ranked(d, [F.col("distance").asc_nulls_last()], limit)


def vector_lane_batch(chunks: DataFrame, queries: DataFrame, metadata_filter: str | dict | None = None, limit: int = LANE_LIMIT) -> DataFrame:
    """As ``vector_lane`` for many queries: a matrix product a batch of chunks.

    Each task keeps the best ``limit`` of every query it has seen in a batch, so
    the shuffle gets no more than that.  Queries come in blocks of QUERY_BLOCK.
    """
    c = allowed(chunks, metadata_filter).select(F.col("id").alias("chunk_id"), "namespace", "embedding")
    id_type = c.schema["chunk_id"].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()
    q = queries.select("query_id", "namespace", "q_emb")
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    spark = chunks.sparkSession
    out = None
    for k in range(blocks):
        # a block of queries comes to the driver at a time
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def score(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            by_ns: dict[str, tuple[list, np.ndarray]] = {}
            for ns in {r[1] for r in shared.value}:
                own = [r for r in shared.value if r[1] == ns]
                m = np.array([r[2] for r in own], np.float64)
                by_ns[ns] = [r[0] for r in own], m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            for pdf in it:
                for ns, part in pdf.groupby("namespace"):
                    if ns not in by_ns:
                        continue
                    ids, m = by_ns[ns]
                    known = part["embedding"].notna().to_numpy()
                    dist = np.full((len(ids), len(part)), np.nan)
                    if known.any():
                        x = np.stack(part["embedding"][known].to_numpy()).astype(np.float64)
                        n = np.linalg.norm(x, axis=1)
                        sim = m @ x.T / np.where(n > 0, n, 1)
                        dist[:, known] = 1 - np.where(n > 0, sim, 0.0)
                    # a rank in this batch can only fall later; ties at the cut all stay
                    order = np.sort(np.where(np.isnan(dist), np.inf, dist), axis=1)
                    cut = order[:, min(limit, len(part)) - 1]
                    keep = (np.where(np.isnan(dist), np.inf, dist) <= cut[:, None])
                    qi, ci = np.nonzero(keep)
                    yield pd.DataFrame({"query_id": [ids[i] for i in qi], "chunk_id": part["chunk_id"].to_numpy()[ci], "distance": dist[qi, ci]})

        # NaN stands for no embedding on the way through Arrow
        got = c.mapInPandas(score, f"query_id {q_type}, chunk_id {id_type}, distance double").withColumn("distance", F.when(F.isnan("distance"), F.lit(None)).otherwise(F.col("distance")))
        out = got if out is None else out.unionByName(got)
    return ranked(out, [F.col("distance").asc_nulls_last()], limit)


def postings(chunks: DataFrame, vocabulary: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """(namespace, lexeme, chunk_id, tf, positions) of every chunk's text.

    Without a vocabulary lexemes are the plain words; with one (token, lexeme)
    words are mapped and those it lacks drop out, their places still counting.
    only: words to index; others leave before they become rows.
    """
    placed = F.transform(simple_tokens("text"), lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
    if only is not None:
        placed = F.filter(placed, lambda x: x["token"].isin(only)) if only else F.filter(placed, lambda x: F.lit(False))
    words = chunks.select("namespace", F.col("id").alias("chunk_id"), F.explode(placed).alias("x")).select("namespace", "chunk_id", "x.pos", "x.token")
    words = words.withColumnRenamed("token", "lexeme") if vocabulary is None else words.join(vocabulary, "token")
    return words.groupBy("namespace", "lexeme", "chunk_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def query_lexemes(queries: DataFrame, english: bool = False) -> DataFrame:
    """(query_id, namespace, lexeme, n): distinct lexemes of each query and their number."""
    words = queries.select("query_id", "namespace", F.explode(F.array_distinct(simple_tokens("q"))).alias("token"))
    if english:
        from ..functions.stem import vocabulary

        words = words.join(vocabulary(words), "token").select("query_id", "namespace", "lexeme").distinct()
    else:
        words = words.withColumnRenamed("token", "lexeme")
    return words.withColumn("n", F.count("*").over(W.partitionBy("query_id")))


def cover_density(places: list[np.ndarray], reach: int = 16) -> float:
    """Sum over the shortest spans that hold every term: 1, or reach / length beyond ``reach``.

    Clarke, Cormack & Tudhope 2000; spans don't contain one another.
    """
    events = sorted((int(p), k) for k, ps in enumerate(places) for p in ps)
    last: dict[int, int] = {}
    spans: list[tuple[int, int]] = []
    for p, k in events:
        last[k] = p
        if len(last) == len(places):
            low = min(last.values())
            if spans and spans[-1][0] == low:
                continue
            spans.append((low, p))
    return float(sum(min(1.0, reach / (b - a + 1)) for a, b in spans))


def text_lane(
    chunks: DataFrame, queries: DataFrame, metadata_filter: str | dict | None = None, limit: int = LANE_LIMIT,
    ranker: str = "cover", english: bool = False, index: DataFrame | None = None,
) -> DataFrame:
    """Chunks that hold every lexeme of the query, best first; a query without lexemes finds nothing.

    ranker: ``cover`` (cover density), ``tf`` (occurrences) or ``bm25``.  index: a
    stored ``postings`` table, else one is built from the chunks.
    """
    if ranker not in ("cover", "tf", "bm25"):
        raise ValueError(f"unknown ranker {ranker!r}")
    own = allowed(chunks, metadata_filter)
    terms = query_lexemes(queries, english)
    words: list[str] | None = [r[0] for r in terms.select("lexeme").distinct().limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        words = None
    if index is not None:
        if metadata_filter is not None:
            index = index.join(own.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        if words is not None:
            # few words: the scan skips files and row groups that hold none of them
            index = index.filter(F.col("lexeme").isin(words))
    elif english:
        from ..functions.stem import vocabulary

        vocab = vocabulary(own.select(F.explode(F.array_distinct(simple_tokens("text"))).alias("token")))
        if words is not None:
            vocab = vocab.filter(F.col("lexeme").isin(words))
        index = postings(own, vocab)
    else:
        index = postings(own, None, words)
    hits = index.join(terms, ["namespace", "lexeme"])
    if ranker == "bm25":
        size = own.select(F.col("id").alias("chunk_id"), "namespace", F.size(simple_tokens("text")).alias("len"))
        stats = size.groupBy("namespace").agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
        df = index.join(terms.select("namespace", "lexeme").distinct(), ["namespace", "lexeme"], "left_semi").groupBy("namespace", "lexeme").agg(F.count("*").alias("df"))
        hits = hits.join(df, ["namespace", "lexeme"]).join(stats, "namespace").join(size.select("chunk_id", "len"), "chunk_id")
        idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        hits = hits.withColumn("part", idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean"))))
        value = F.sum("part")
    else:
        value = F.sum("tf").cast("double")
    full = hits.groupBy("query_id", "chunk_id").agg(F.count("*").alias("got"), F.first("n").alias("n"), value.alias("rank"), *([F.collect_list("positions").alias("places")] if ranker == "cover" else []))
    full = full.filter("got = n")
    if ranker == "cover":

        @F.pandas_udf("double")
        def cover(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(cover_density).astype(float)

        full = full.withColumn("rank", cover("places")).drop("places")
    return ranked(full.select("query_id", "chunk_id", "rank"), [F.col("rank").desc()], limit)


def seeds(entities: DataFrame, queries: DataFrame, threshold: float = SEED_DISTANCE, limit: int = SEED_LIMIT) -> DataFrame:
    """(query_id, entity_id, distance): nearest entities of the namespace, strictly below the threshold."""
    e = entities.filter(F.col("name_emb").isNotNull()).select(F.col("id").alias("entity_id"), "namespace", "name_emb")
    pairs = _against(e, queries)
    near = pairs.select("query_id", "entity_id", cosine_distance("name_emb", "q_emb").alias("distance")).filter(F.col("distance") < threshold)
    return ranked(near, [F.col("distance").asc()], limit, "entity_id").drop("rk")


def symmetrized(relationships: DataFrame) -> DataFrame:
    """(src, dst) in both directions; a self-loop stays one edge, parallel edges stay parallel."""
    e = relationships.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return e.unionAll(e.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def walk(start: DataFrame, relationships: DataFrame, hops: int) -> DataFrame:
    """(query_id, entity_id, d, cnt): numbers of undirected walks of up to ``hops`` steps.

    Walks may turn back and take parallel edges; cnt carries their number, so
    rows never outgrow entities.  Edges are joined by equality in both
    directions instead of by an OR.
    """
    edges = symmetrized(relationships)
    front = start.select("query_id", "entity_id").withColumn("d", F.lit(0)).withColumn("cnt", F.lit(1).cast("long"))
    out = front
    for d in range(1, hops + 1):
        step = front.join(edges, front.entity_id == edges.src).groupBy("query_id", F.col("dst").alias("entity_id")).agg(F.sum("cnt").alias("cnt"))
        front = step.select("query_id", "entity_id", F.lit(d).alias("d"), "cnt")
        if d > 4 and d % 4 == 0 and d < hops:
            front = cut(front)
        out = out.unionByName(front)
    return out


def walk_sql(start_view: str, edges_view: str, hops: int) -> str:
    """The same walk as one recursive statement, for small graphs."""
    return f"""
WITH RECURSIVE w(query_id, entity_id, d) AS (
  SELECT query_id, entity_id, 0 FROM {start_view}
  UNION ALL SELECT w.query_id, e.dst, w.d + 1 FROM w JOIN {edges_view} e ON w.entity_id = e.src WHERE w.d < {int(hops)})
SELECT query_id, entity_id, d, count(*) AS cnt FROM w GROUP BY query_id, entity_id, d"""


def graph_lane(
    chunks: DataFrame, mentions: DataFrame, entities: DataFrame, relationships: DataFrame, queries: DataFrame, hops: int = 1,
    metadata_filter: str | dict | None = None, limit: int = LANE_LIMIT, seed_threshold: float = SEED_DISTANCE,
) -> DataFrame:
    """Chunks by the number of walks from the query's seeds to the entities they mention.

    Zero hops close the lane, seeds or no.  Edges aren't held to the namespace;
    seeds and chunks are.
    """
    if hops < 1:
        empty = queries.select("query_id").join(chunks.select(F.col("id").alias("chunk_id")), F.lit(False))
        return empty.select("query_id", "chunk_id", F.lit(0).cast("long").alias("walks"), F.lit(0).alias("rk"))
    reached = walk(seeds(entities, queries, seed_threshold), relationships, hops).groupBy("query_id", "entity_id").agg(F.sum("cnt").alias("cnt"))
    own = allowed(chunks, metadata_filter).select(F.col("id").alias("chunk_id"), "namespace")
    hits = mentions.join(reached, "entity_id").join(queries.select("query_id", "namespace"), "query_id").join(own, ["chunk_id", "namespace"])
    return ranked(hits.groupBy("query_id", "chunk_id").agg(F.sum("cnt").alias("walks")), [F.col("walks").desc()], limit)


def degree(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(entity_id, degree): incident edges of every entity, self-loops once."""
    ends = symmetrized(relationships).groupBy(F.col("src").alias("entity_id")).agg(F.count("*").alias("degree"))
    return entities.select(F.col("id").alias("entity_id")).join(ends, "entity_id", "left").select("entity_id", F.coalesce("degree", F.lit(0)).alias("degree"))
