"""Reciprocal rank fusion of lanes, and retrieval built from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import RRF_K, SEED_DISTANCE, Mode
from . import lanes as L


@dataclass(frozen=True)
class Weights:
    """Lane weights.  Negative ones count as zero; a zero lane still lends its rows."""

    vec: float = 1.0
    bm25: float = 1.0
    graph: float = 1.0

    def __post_init__(self) -> None:
        for lane in ("vec", "bm25", "graph"):
            object.__setattr__(self, lane, max(0.0, float(getattr(self, lane))))

    @classmethod
    def parse(cls, given: dict | None) -> "Weights":
        """Missing and non-numeric weights are 1."""
        number = lambda v: v if isinstance(v, (int, float)) and not isinstance(v, bool) else 1.0
        return cls(**{k: number((given or {}).get(k, 1.0)) for k in ("vec", "bm25", "graph")})

    def of(self, lane: str) -> float:
        return getattr(self, lane, 0.0)


def fuse(ranked: dict[str, DataFrame], weights: Weights = Weights(), k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, signals) from lanes of (query_id, chunk_id, rk)."""
    rows = [df.select("query_id", "chunk_id", F.lit(lane).alias("lane"), F.col("rk").cast("int").alias("rk"), F.lit(weights.of(lane)).alias("w")) for lane, df in ranked.items()]
    every = reduce(DataFrame.unionByName, rows)
    return every.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("w") * (F.lit(1.0) / (F.lit(float(k)) + F.col("rk")))).alias("score"),
        F.sort_array(F.collect_list(F.struct("lane", "rk", "w"))).alias("signals"),
    )


@dataclass
class Graph:
    """The tables that retrieval reads."""

    chunks: DataFrame
    entities: DataFrame
    relationships: DataFrame
    mentions: DataFrame
    index: DataFrame | None = None


def retrieve(
    graph: Graph, queries: DataFrame, mode: str = "hybrid", top_k: int = 10, hops: int = 1, weights: dict | None = None,
    metadata_filter: str | dict | None = None, ranker: str = "cover", english: bool = False, batch: bool = False, seed_threshold: float = SEED_DISTANCE,
    near: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """Answer a batch of queries (query_id, q, q_emb, namespace).

    Returns query_id, chunk_id, document_id, text, score, signals; at most top_k
    rows a query, by falling score and rising chunk id.  Lanes that the mode
    closes aren't built.  near: another vector lane than the exact one.
    """
    ranked: dict[str, DataFrame] = {}
    for lane in Mode.parse(mode).lanes:
        if lane == "vec":
            ranked[lane] = (near or (L.vector_lane_batch if batch else L.vector_lane))(graph.chunks, queries, metadata_filter)
        elif lane == "bm25":
            ranked[lane] = L.text_lane(graph.chunks, queries, metadata_filter, ranker=ranker, english=english, index=graph.index)
        else:
            ranked[lane] = L.graph_lane(graph.chunks, graph.mentions, graph.entities, graph.relationships, queries, hops, metadata_filter, seed_threshold=seed_threshold)
    fused = fuse(ranked, Weights.parse(weights))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    top = fused.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top_k).drop("place")
    # texts are joined to the few rows that are left
    texts = graph.chunks.select(F.col("id").alias("chunk_id"), "document_id", "text")
    return top.join(texts, "chunk_id").select("query_id", "chunk_id", "document_id", "text", "score", "signals")


def signals_text(signals: str = "signals"):
    """Signals as one string ``lane:rank:weight,…``."""
    return F.array_join(F.transform(signals, lambda s: F.concat_ws(":", s["lane"], s["rk"].cast("string"), F.format_number(s["w"], 2))), ",")
