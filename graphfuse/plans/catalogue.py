"""Every operator as a query over the driver's tables, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import ask, evalx
from ..functions import jsonx, text, vector
from ..operators import chunking, fusion, ivf, lanes, resolve, tables
from ..sources import bench_tables as B
from ..sources import fixture
from ..streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def graph_sql(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{B.SQL}{body}"


SIX = lambda c: F.round(c, 6)
SIM = "CASE WHEN c.embedding IS NULL THEN NULL ELSE 1 - list_cosine_similarity(c.embedding, q.q_emb) END"


def _one(spark: SparkSession, d: str, label: int = 0) -> DataFrame:
    return B.queries(spark, d).filter(F.col("query_id") == label)


# vector lane


def _vector_sql(where: str, queries: str = "query_id = 0", limit: int = 50, ns: str = "c.namespace = 'en'") -> str:
    return graph_sql(f"""
, d AS (SELECT q.query_id, c.id, {SIM} AS dist FROM g_chunks c, g_queries q WHERE {queries} AND {ns} AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist ASC NULLS LAST, id) AS rk FROM d)
SELECT query_id, id AS chunk_id, rk::INT AS rk, round(dist, 6) AS distance FROM r WHERE rk <= {limit}""")


def _shown(lane: DataFrame) -> DataFrame:
    return lane.select("query_id", "chunk_id", "rk", SIX("distance").alias("distance"))


@registered(_vector_sql("true"))
def vector_topk(spark, d):
    return _shown(lanes.vector_lane(B.chunks(spark, d), _one(spark, d)))


@registered(graph_sql("""
, d AS (SELECT q.id AS query_id, c.id, CASE WHEN c.embedding IS NULL THEN NULL ELSE 1 - list_cosine_similarity(c.embedding, q.embedding) END AS dist
  FROM g_chunks c JOIN g_chunks q ON q.namespace = c.namespace WHERE q.id % 50 = 0 AND q.embedding IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9) ASC NULLS LAST, id) AS rk FROM d)
SELECT query_id, id AS chunk_id, rk::INT AS rk, round(abs(dist), 6) AS distance FROM r WHERE rk <= 50"""))
def vector_topk_batch(spark, d):
    return lanes.vector_lane_batch(B.chunks(spark, d), B.row_queries(spark, d)).select("query_id", "chunk_id", "rk", SIX(F.abs("distance")).alias("distance"))


@registered(_vector_sql("c.source = 'src3'"))
def vector_topk_filtered(spark, d):
    return _shown(lanes.vector_lane(B.chunks(spark, d), _one(spark, d), {"source": "src3"}))


@registered(_vector_sql("true", ns="c.namespace = 'fr'"))
def vector_topk_namespace(spark, d):
    return _shown(lanes.vector_lane(B.chunks(spark, d), _one(spark, d).withColumn("namespace", F.lit("fr"))))


@registered(_vector_sql("c.source = 'src5'", limit=100_000))
def vector_null_last(spark, d):
    return _shown(lanes.vector_lane(B.chunks(spark, d), _one(spark, d), {"source": "src5"}, limit=100_000))


# seeds and walks


def _seeds(hidden: float, label: str = "true") -> str:
    return f"""
, sd AS (SELECT q.query_id, e.id AS entity_id, 1 - list_cosine_similarity(e.name_emb, q.q_emb) AS dist FROM g_entities e, g_queries q WHERE e.name_emb IS NOT NULL AND {label}),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, entity_id) AS rk FROM sd WHERE dist < {hidden}),
seeds AS MATERIALIZED (SELECT query_id, entity_id, dist FROM sr WHERE rk <= 8)"""


@registered(graph_sql(_seeds(0.35) + " SELECT query_id, entity_id, round(dist, 6) AS distance FROM seeds"))
def seeds_threshold(spark, d):
    return lanes.seeds(B.entities(spark, d), B.queries(spark, d)).select("query_id", "entity_id", SIX(F.abs("distance")).alias("distance"))


SQL["seeds_threshold"] = SQL["seeds_threshold"].replace("round(dist, 6)", "round(abs(dist), 6)")


@registered(graph_sql(_seeds(2.0) + " SELECT query_id, entity_id, round(abs(dist), 6) AS distance FROM seeds"))
def seeds_topk(spark, d):
    return lanes.seeds(B.entities(spark, d), B.queries(spark, d), 2.0).select("query_id", "entity_id", SIX(F.abs("distance")).alias("distance"))


def _walk_sql(hops: int) -> str:
    return f"""{_seeds(0.35)},
w(query_id, entity_id, d) AS (
  SELECT query_id, entity_id, 0 FROM seeds
  UNION ALL SELECT w.query_id, e.dst, w.d + 1 FROM w JOIN g_edges e ON w.entity_id = e.src WHERE w.d < {hops})"""


def _walk(spark, d, hops, queries):
    return lanes.walk(lanes.seeds(B.entities(spark, d), queries), B.relationships(spark, d), hops).groupBy("query_id", "entity_id").agg(F.sum("cnt").alias("cnt"))


_COUNT = " SELECT query_id, entity_id, count(*) AS cnt FROM w GROUP BY 1, 2"


@registered(graph_sql(_walk_sql(1) + _COUNT, True))
def walk_h1(spark, d):
    return _walk(spark, d, 1, B.queries(spark, d))


@registered(graph_sql(_walk_sql(2) + _COUNT, True))
def walk_h2(spark, d):
    return _walk(spark, d, 2, B.queries(spark, d))


@registered(graph_sql(_walk_sql(3) + _COUNT, True))
def walk_h3_counts(spark, d):
    return _walk(spark, d, 3, B.queries(spark, d))


@registered(graph_sql(_walk_sql(2) + " SELECT query_id, entity_id, d, count(*) AS cnt FROM w GROUP BY 1, 2, 3", True))
def walk_recursive_sql(spark, d):
    lanes.seeds(B.entities(spark, d), B.queries(spark, d)).createOrReplaceTempView("gf_seeds")
    lanes.symmetrized(B.relationships(spark, d)).createOrReplaceTempView("gf_edges")
    return spark.sql(lanes.walk_sql("gf_seeds", "gf_edges", 2))


def _graph_lane_sql(hops: int, where: str = "true") -> str:
    return f"""{_walk_sql(hops)},
gl AS (SELECT w.query_id, c.id AS chunk_id, count(*) AS walks FROM w JOIN g_mentions m ON m.entity_id = w.entity_id JOIN g_chunks c ON c.id = m.chunk_id WHERE c.namespace = 'en' AND {where} GROUP BY 1, 2),
graph AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY walks DESC, chunk_id) AS rk FROM gl) WHERE rk <= 50)"""


def _graph_lane(spark, d, hops):
    return lanes.graph_lane(B.chunks(spark, d), B.mentions(spark, d), B.entities(spark, d), B.relationships(spark, d), B.queries(spark, d), hops).select("query_id", "chunk_id", "walks", "rk")


@registered(graph_sql(_graph_lane_sql(1) + " SELECT query_id, chunk_id, walks, rk::INT AS rk FROM graph", True))
def graph_lane(spark, d):
    return _graph_lane(spark, d, 1)


@registered(graph_sql(_graph_lane_sql(2) + " SELECT query_id, chunk_id, walks, rk::INT AS rk FROM graph", True))
def graph_lane_hops2(spark, d):
    return _graph_lane(spark, d, 2)


@registered("SELECT 0::INT AS query_id, 0::BIGINT AS chunk_id, 0::BIGINT AS walks, 0::INT AS rk WHERE false")
def graph_lane_hops0(spark, d):
    return _graph_lane(spark, d, 0)


@registered(graph_sql(" SELECT e.id AS entity_id, coalesce(n, 0) AS degree FROM g_entities e LEFT JOIN (SELECT src, count(*) AS n FROM g_edges GROUP BY 1) x ON x.src = e.id"))
def entity_degree(spark, d):
    return lanes.degree(B.entities(spark, d), B.relationships(spark, d))


@registered("""
WITH e AS (
  SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e WHERE src <> dst),
w0 AS (SELECT 'r0' AS id, 1::HUGEINT AS cnt),
w1 AS (SELECT dst AS id, sum(cnt) AS cnt FROM w0 JOIN s ON s.src = w0.id GROUP BY 1),
w2 AS (SELECT dst AS id, sum(cnt) AS cnt FROM w1 JOIN s ON s.src = w1.id GROUP BY 1),
w3 AS (SELECT dst AS id, sum(cnt) AS cnt FROM w2 JOIN s ON s.src = w2.id GROUP BY 1)
SELECT d, id AS entity_id, cnt::BIGINT AS cnt FROM (SELECT 0 AS d, * FROM w0 UNION ALL SELECT 1, * FROM w1 UNION ALL SELECT 2, * FROM w2 UNION ALL SELECT 3, * FROM w3)""")
def walk_big_graph(spark, d):
    pair = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x)).alias("src_id"), F.concat(F.lit(b), F.col(y)).alias("dst_id"))
    r = lambda t: B.read(spark, d, t)
    edges = (
        pair(r("lineitem"), "p", "l_partkey", "s", "l_suppkey")
        .unionAll(pair(r("supplier"), "s", "s_suppkey", "n", "s_nationkey"))
        .unionAll(pair(r("customer"), "c", "c_custkey", "n", "c_nationkey"))
        .unionAll(pair(r("nation"), "n", "n_nationkey", "r", "n_regionkey"))
    )
    return lanes.walk(spark.createDataFrame([(0, "r0")], "query_id int, entity_id string"), edges, 3).select("d", "entity_id", "cnt")


# text lane

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_TEXT = rf"""
, tok AS MATERIALIZED (SELECT id, namespace, source, {_TOKENS} AS w FROM g_chunks),
post AS MATERIALIZED (SELECT namespace, lexeme, id AS chunk_id, count(*) AS tf FROM (SELECT namespace, id, unnest(w) AS lexeme FROM tok) GROUP BY 1, 2, 3),
terms AS MATERIALIZED (SELECT query_id, unnest(list_distinct({_TOKENS.replace("text", "q")})) AS lexeme FROM g_queries),
need AS (SELECT query_id, count(*) AS n FROM terms GROUP BY 1)"""


def _text_sql(where: str = "true") -> str:
    return f"""{_TEXT},
bh AS (SELECT t.query_id, p.chunk_id, count(*) AS got, sum(p.tf)::DOUBLE AS rank FROM post p JOIN terms t ON t.lexeme = p.lexeme JOIN g_chunks c ON c.id = p.chunk_id WHERE p.namespace = 'en' AND {where} GROUP BY 1, 2),
bm25 AS MATERIALIZED (SELECT * FROM (SELECT bh.*, row_number() OVER (PARTITION BY bh.query_id ORDER BY rank DESC, chunk_id) AS rk FROM bh JOIN need USING (query_id) WHERE got = n) WHERE rk <= 50)"""


@registered(graph_sql(_TEXT + ", f AS (SELECT t.query_id, p.chunk_id, count(*) AS got FROM post p JOIN terms t USING (lexeme) WHERE p.namespace = 'en' GROUP BY 1, 2) SELECT query_id, chunk_id FROM f JOIN need USING (query_id) WHERE got = n"))
def fts_match_all(spark, d):
    return lanes.text_lane(B.chunks(spark, d), B.queries(spark, d), ranker="tf", limit=2_000_000_000).select("query_id", "chunk_id")


@registered(graph_sql(_text_sql() + " SELECT query_id, chunk_id, rank, rk::INT AS rk FROM bm25"))
def fts_tf_rank(spark, d):
    return lanes.text_lane(B.chunks(spark, d), B.queries(spark, d), ranker="tf")


@registered(graph_sql(_text_sql("c.source = 'src3'") + " SELECT query_id, chunk_id, rank, rk::INT AS rk FROM bm25"))
def fts_filtered(spark, d):
    return lanes.text_lane(B.chunks(spark, d), B.queries(spark, d), {"source": "src3"}, ranker="tf")


@registered(graph_sql(_TEXT + " SELECT namespace, lexeme, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY 1, 2"))
def postings_df(spark, d):
    return lanes.postings(B.chunks(spark, d)).groupBy("namespace", "lexeme").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@registered(graph_sql(_TEXT + """
, st AS (SELECT namespace, count(*) AS docs, avg(len(w)) AS mean FROM tok GROUP BY 1),
df AS (SELECT lexeme, count(*) AS df FROM post WHERE namespace = 'en' GROUP BY 1),
h AS (SELECT t.query_id, p.chunk_id, count(*) AS got, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(k.w) / mean))) AS rank
  FROM post p JOIN terms t USING (lexeme) JOIN df USING (lexeme) JOIN st ON st.namespace = p.namespace JOIN tok k ON k.id = p.chunk_id WHERE p.namespace = 'en' GROUP BY 1, 2)
SELECT query_id, chunk_id, round(rank, 6) AS rank FROM h JOIN need USING (query_id) WHERE got = n"""))  # fmt: skip
def fts_bm25_scores(spark, d):
    return lanes.text_lane(B.chunks(spark, d), B.queries(spark, d), ranker="bm25", limit=2_000_000_000).select("query_id", "chunk_id", SIX("rank").alias("rank"))


@registered()
def fts_cover_density(spark, d):
    return lanes.text_lane(B.chunks(spark, d), B.queries(spark, d), ranker="cover")


@registered(graph_sql(_TEXT + """
, pos AS (SELECT t.query_id, u.id AS chunk_id, u.p, u.lexeme FROM (SELECT id, namespace, unnest(w) AS lexeme, generate_subscripts(w, 1) AS p FROM tok) u JOIN terms t ON t.lexeme = u.lexeme WHERE u.namespace = 'en'),
ev AS (SELECT *, lag(p) OVER o AS p0, lag(lexeme) OVER o AS l0 FROM pos WINDOW o AS (PARTITION BY query_id, chunk_id ORDER BY p))
SELECT query_id, chunk_id, round(CASE WHEN any_value(n) = 1 THEN count(*) ELSE sum(CASE WHEN l0 <> lexeme THEN least(1.0, 16.0 / (p - p0 + 1)) ELSE 0 END) END::DOUBLE, 6) AS rank
FROM ev JOIN need USING (query_id) WHERE n <= 2 GROUP BY 1, 2 HAVING count(DISTINCT lexeme) = any_value(n)"""))
def fts_cover_density_scores(spark, d):
    """Scores of the default ranker; with two terms at most a cover is two neighbouring places, which SQL can say."""
    q = B.queries(spark, d).filter(F.size(F.split("q", " ")) <= 2)
    return lanes.text_lane(B.chunks(spark, d), q, ranker="cover", limit=2_000_000_000).select("query_id", "chunk_id", SIX("rank").alias("rank"))


@registered()
def fts_english(spark, d):
    return lanes.text_lane(B.chunks(spark, d), B.queries(spark, d), ranker="cover", english=True)


# fusion


def _hybrid_sql(lanes_: tuple[str, ...] = ("vec", "bm25", "graph"), weights: tuple[float, float, float] = (1, 1, 1), queries: str = "true", hops: int = 1, vec_where: str = "true", tail: str = "") -> str:
    w = dict(zip(("vec", "bm25", "graph"), weights, strict=True))
    parts = " UNION ALL ".join(f"SELECT query_id, {'id' if lane == 'vec' else 'chunk_id'} AS chunk_id, rk, '{lane}' AS lane, {w[lane]}::DOUBLE AS w FROM {lane}" for lane in lanes_)
    return graph_sql(f"""{_graph_lane_sql(hops, vec_where)}{_text_sql(vec_where)},
vd AS (SELECT q.query_id, c.id, {SIM} AS dist FROM g_chunks c, g_queries q WHERE c.namespace = 'en' AND {vec_where}),
vec AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist ASC NULLS LAST, id) AS rk FROM vd) WHERE rk <= 50),
u AS ({parts}),
fu AS (SELECT query_id, chunk_id, sum(w / (60 + rk)) AS score, string_agg(lane || ':' || rk || ':' || printf('%.2f', w), ',' ORDER BY lane) AS signals FROM u WHERE {queries} GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS place FROM fu) WHERE place <= 10)
{tail or 'SELECT query_id, chunk_id, round(score, 6) AS score, signals FROM top'}""", True)


def _hybrid(spark, d, queries=None, **kw):
    q = queries if queries is not None else _one(spark, d)
    out = fusion.retrieve(B.graph(spark, d), q, ranker="tf", **kw)
    return out.select("query_id", "chunk_id", SIX("score").alias("score"), fusion.signals_text().alias("signals"))


@registered(_hybrid_sql(queries="query_id = 0"))
def hybrid_default(spark, d):
    return _hybrid(spark, d)


@registered(_hybrid_sql(queries="query_id = 0", weights=(2, 0, 1)))
def hybrid_weighted(spark, d):
    return _hybrid(spark, d, weights={"vec": 2, "bm25": 0, "graph": 1})


@registered(_hybrid_sql(queries="query_id = 0", weights=(1, 0, 1)))
def hybrid_negative_weight(spark, d):
    return _hybrid(spark, d, weights={"bm25": -1, "vec": "x"})


@registered(_hybrid_sql(("vec",), queries="query_id = 0"))
def mode_vector(spark, d):
    return _hybrid(spark, d, mode="vector")


@registered(_hybrid_sql(("bm25",), queries="query_id = 0"))
def mode_bm25(spark, d):
    return _hybrid(spark, d, mode="bm25")


@registered(_hybrid_sql(("graph",), queries="query_id = 0"))
def mode_graph(spark, d):
    return _hybrid(spark, d, mode="graph")


@registered(_hybrid_sql(("vec", "bm25", "graph"), queries="query_id = 0", vec_where="c.source = 'src3'"))
def hybrid_filtered(spark, d):
    return _hybrid(spark, d, metadata_filter={"source": "src3"})


@registered(_hybrid_sql())
def hybrid_batch(spark, d):
    return _hybrid(spark, d, B.queries(spark, d), batch=True)


@registered(_hybrid_sql(queries="query_id = 3", hops=2))
def hybrid_hops2(spark, d):
    return _hybrid(spark, d, _one(spark, d, 3), hops=2)


@registered(_hybrid_sql(tail="SELECT t.query_id, t.chunk_id, c.id AS document_id, sha256(c.text) AS text_hash FROM top t JOIN g_chunks c ON c.id = t.chunk_id"))
def hybrid_projection(spark, d):
    out = fusion.retrieve(B.graph(spark, d), B.queries(spark, d), ranker="tf", batch=True)
    return out.select("query_id", "chunk_id", "document_id", F.sha2("text", 256).alias("text_hash"))


@registered(_hybrid_sql(tail="SELECT query_id, chunk_id, s.lane AS lane, s.rk::INT AS rk FROM (SELECT t.query_id, t.chunk_id, u.lane, u.rk FROM top t JOIN u USING (query_id, chunk_id)) s"))
def hybrid_signals(spark, d):
    out = fusion.retrieve(B.graph(spark, d), B.queries(spark, d), ranker="tf", batch=True)
    return out.select("query_id", "chunk_id", F.explode("signals").alias("s")).select("query_id", "chunk_id", "s.lane", "s.rk")


@registered("""
WITH a AS (SELECT l_orderkey % 500 AS id, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_orderkey % 500) AS rk FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey % 500 AS id, row_number() OVER (ORDER BY count(*) DESC, l_orderkey % 500) AS rk FROM lineitem GROUP BY 1),
u AS (SELECT id, rk, 2.0::DOUBLE AS w FROM a WHERE rk <= 50 UNION ALL SELECT id, rk, 1.0 FROM b WHERE rk <= 50)
SELECT id AS chunk_id, round(sum(w / (60 + rk)), 6) AS score FROM u GROUP BY 1""")
def rrf_fuse(spark, d):
    li = B.read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("chunk_id")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    # limit first, so that the global rank sees fifty rows
    rank = lambda c: li.orderBy(F.col(c).desc(), "chunk_id").limit(50).select(F.lit(0).alias("query_id"), "chunk_id", F.row_number().over(W.orderBy(F.col(c).desc(), "chunk_id")).alias("rk"))
    return fusion.fuse({"vec": rank("q"), "bm25": rank("n")}, fusion.Weights(vec=2.0)).select("chunk_id", SIX("score").alias("score"))


# documents, chunks, hashes


@registered("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return B.read(spark, d, "documents").select("doc_id", text.content_hash("text").alias("content_hash"))


@registered("SELECT doc_id AS id, namespace, content_hash FROM (SELECT doc_id, lang AS namespace, sha256(text) AS content_hash, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, d):
    return tables.first_of(B.documents(spark, d).select("id", "namespace", "content_hash"), ("namespace", "content_hash"), [F.col("id")])


@registered("""
WITH a AS (SELECT doc_id, lang, sha256(text) AS h FROM documents)
SELECT min(doc_id) AS id, lang AS namespace, h AS content_hash FROM a WHERE doc_id % 3 <> 0 AND (lang, h) NOT IN (SELECT lang, h FROM a WHERE doc_id % 3 = 0) GROUP BY 2, 3""")
def dedup_skip_existing(spark, d):
    docs = B.documents(spark, d).select("id", "namespace", "content_hash")
    return tables.new_rows(docs.filter("id % 3 <> 0"), docs.filter("id % 3 = 0"), ("namespace", "content_hash"), [F.col("id")])


@registered(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS token_count FROM documents")
def token_count(spark, d):
    return B.read(spark, d, "documents").select("doc_id", text.token_count("text").alias("token_count"))


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@registered(f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 150)) AS p FROM w)
SELECT doc_id AS document_id, (p // 150)::INT AS ord, sha256(array_to_string(w[p + 1:p + 300], ' ')) AS h, least(300, len(w) - p)::INT AS token_count FROM s""")
def chunk_fixed_overlap(spark, d):
    docs = B.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return chunking.chunk(docs, "fixed_overlap").select("document_id", "ord", F.sha2("text", 256).alias("h"), "token_count")


@registered(f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[p + 1:p + 300], ' ') AS t, p // 150 AS ord FROM (SELECT doc_id, w, unnest(range(0, len(w), 150)) AS p FROM w)),
n AS (SELECT doc_id, ord, concat_ws(chr(10), lag(t) OVER o, t, lead(t) OVER o) AS t FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id AS document_id, ord::INT AS ord, sha256(left(t, 2000)) AS h FROM n""")
def chunk_neighbor_expand(spark, d):
    docs = B.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return chunking.neighbor_expand(chunking.fixed_overlap(docs)).select("document_id", "ord", F.sha2("text", 256).alias("h"))


@registered()
def chunk_sentence_aware(spark, d):
    return chunking.chunk(B.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text"), "auto")


@registered()
def chunk_hierarchy(spark, d):
    return chunking.chunk(B.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text"), "hierarchy")


@registered("""
WITH h AS (SELECT s_suppkey, sha256(s_name::BLOB || '\\x00\\x00\\x00\\x00'::BLOB) AS h FROM supplier),
w AS (SELECT s_suppkey, i, (('0x' || h[i*8+7:i*8+8] || h[i*8+5:i*8+6] || h[i*8+3:i*8+4] || h[i*8+1:i*8+2])::UBIGINT::DOUBLE / 4294967295 * 2 - 1)::FLOAT::DOUBLE AS v FROM h, range(8) t(i)),
n AS (SELECT s_suppkey, sqrt(sum(v * v)) AS n FROM w GROUP BY 1)
SELECT s_suppkey, i::INT AS i, round((v / n)::FLOAT::DOUBLE, 5) AS v FROM w JOIN n USING (s_suppkey)""")
def hash_embed_dim8(spark, d):
    e = B.read(spark, d, "supplier").select("s_suppkey", F.posexplode(vector.hash_embed("s_name", 8)).alias("i", "v"))
    return e.select("s_suppkey", "i", F.round(F.col("v").cast("double"), 5).alias("v"))


@registered(r"""
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || h[17])::INT % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT doc_id, sha256(lang || chr(31) || source || chr(31) || doc_id) AS h FROM documents)""")
def stable_ids(spark, d):
    return B.read(spark, d, "documents").select("doc_id", text.stable_uuid("lang", "source", "doc_id").alias("id"))


# resolution

_GRAMS = "(SELECT id, unnest(list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))) AS t FROM (SELECT id, '  ' || lower(name) || '  ' AS p FROM names))"


def _pairs_sql(names: str, threshold: float) -> str:
    return f"""
WITH names AS ({names}), g AS MATERIALIZED {_GRAMS}, n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
k AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g a JOIN g b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, round(k / (x.n + y.n - k), 6) AS similarity FROM k JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k / (x.n + y.n - k) >= {threshold}"""


def _part_names(spark, d):
    return B.read(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).select("id", "name")


def _supplier_names(spark, d):
    return B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


@registered(_pairs_sql("SELECT s_suppkey AS id, s_name AS name FROM supplier", 0.7))
def trigram_pairs(spark, d):
    return resolve.trigram_pairs(_supplier_names(spark, d), 0.7).select("a", "b", SIX("similarity").alias("similarity"))


@registered(_pairs_sql("SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY 2", 0.4))
def resolve_pairs(spark, d):
    return resolve.trigram_pairs(_part_names(spark, d), 0.4).select("a", "b", SIX("similarity").alias("similarity"))


@registered(f"""
WITH names AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY 2), g AS MATERIALIZED {_GRAMS}, n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
k AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g a JOIN g b ON a.t = b.t GROUP BY 1, 2),
s AS (SELECT a, b, k / (x.n + y.n - k) AS sim FROM k JOIN n x ON x.id = a JOIN n y ON y.id = b),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rk FROM s)
SELECT a AS mention_id, b AS entity_id, round(sim, 6) AS similarity, rk::INT AS rk FROM r WHERE rk <= 8""")
def trigram_candidates_top8(spark, d):
    p = _part_names(spark, d).withColumn("namespace", F.lit("x"))
    return resolve.candidates(p, p).select("mention_id", "entity_id", SIX("similarity").alias("similarity"), "rk")


@registered("""
WITH names AS (SELECT min(p_partkey) * 2 AS id, p_name AS name FROM part GROUP BY 2)
SELECT id, id AS canonical FROM names UNION ALL SELECT id + 1, id FROM names""")
def resolve_canonical(spark, d):
    p = _part_names(spark, d).select((F.col("id") * 2).alias("id"), "name")
    both = p.unionByName(p.select((F.col("id") + 1).alias("id"), F.upper("name").alias("name"))).withColumn("name_emb", vector.name_vector("name"))
    return resolve.canonical(both)


@registered()
def resolve_canonical_loose(spark, d):
    return resolve.canonical(_supplier_names(spark, d), 0.7, None)


@registered("""
WITH e AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS emb FROM embeddings GROUP BY 1)
SELECT 'l' || label || 'name' AS mention_id, 'L' || label || 'NAME' AS entity_id FROM e""")
def resolve_merge(spark, d):
    e = B.read(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("name_emb"))
    named = lambda a, b: e.select(F.concat(F.lit(a), "label", F.lit(b)).alias("id"), F.concat(F.lit(a), "label", F.lit(b)).alias("name"), "name_emb", F.lit("x").alias("namespace"))
    return resolve.merge_decision(named("l", "name"), named("L", "NAME"))


# fixtures, writes


@registered("""
SELECT 'document' AS kind, count(*) AS n, NULL::DOUBLE AS w FROM documents UNION ALL
SELECT 'relationship', count(*), count(*) * 1.0 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'chunk_entity', count(*), NULL FROM documents""")
def fixture_parse(spark, d):
    doc = B.read(spark, d, "documents")
    line = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()])).alias("value")
    rows = (
        doc.select(line(kind=F.lit("document"), id=F.col("doc_id").cast("string"), namespace=F.col("lang"), source=F.col("source"), content_hash=F.sha2("text", 256)))
        .unionAll(doc.filter("doc_id % 2 = 0").select(line(kind=F.lit("relationship"), id=F.col("doc_id").cast("string"), src_id=F.lit("a"), dst_id=F.lit("b"), kind_label=F.lit("next"))))
        .unionAll(doc.select(line(kind=F.lit("chunk_entity"), chunk_id=F.col("doc_id").cast("string"), entity_id=F.lit("e"))))
        .unionAll(doc.select(F.lit("  ").alias("value")))
    )
    r = fixture.parse(rows, "default").filter("error is null")
    return r.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "relationship", F.col("weight"))).alias("w"))


@registered("SELECT lang AS namespace, source AS name, min(doc_id)::VARCHAR AS id FROM documents GROUP BY 1, 2")
def fixture_conflicts(spark, d):
    doc = B.read(spark, d, "documents")
    rows = doc.select(F.to_json(F.struct(F.lit("entity").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("namespace"), F.col("source").alias("name"), F.lit("k").alias("kind_label"))).alias("value"))
    e = fixture.split(fixture.parse(rows))["entities"]
    return tables.new_rows(e, e.limit(0), ("namespace", "name", "kind"), [F.col("id").cast("long")]).select("namespace", "name", "id")


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT min(o_orderkey), o_custkey FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY o_custkey")
def anti_append(spark, d):
    o = B.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return tables.anti_append(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ("o_custkey",), [F.col("o_orderkey")])


@registered("SELECT p_partkey AS id, NULL AS kind, p_name AS name FROM part WHERE p_size % 2 = 0 UNION ALL SELECT min(p_partkey), p_brand, p_name FROM part WHERE p_size % 2 = 1 GROUP BY 2, 3")
def entity_null_kind(spark, d):
    p = B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")).alias("kind"), F.col("p_name").alias("name"))
    return tables.new_rows(p, p.limit(0), ("name", "kind"), [F.col("id")])


@registered("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def upsert_latest(spark, d):
    e = B.read(spark, d, "events").select("user_id", "event_id", "event_type")
    old = e.filter("event_id % 5 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))
    # rows at or after the stored one replace it
    fresh = e.join(old.select("user_id", F.col("event_id").alias("have")), "user_id", "left").filter("have is null or event_id >= have").drop("have")
    return tables.upsert(old, fresh, ("user_id",), [F.col("event_id")])


@registered("""
SELECT 'documents' AS t, count(*) AS n FROM documents WHERE source <> 'src3' UNION ALL SELECT 'chunks', count(*) FROM documents WHERE source <> 'src3'
UNION ALL SELECT 'chunk_entities', (SELECT count(*) FROM documents WHERE source <> 'src3') + (SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id WHERE source <> 'src3')""")
def cascade_delete(spark, d):
    docs = B.documents(spark, d)
    t = {"documents": docs, "chunks": B.chunks(spark, d), "chunk_entities": B.mentions(spark, d)}
    left = tables.delete_documents(t, docs.filter("source = 'src3'").select("id"))
    count = lambda n: left[n].agg(F.lit(n).alias("t"), F.count("*").alias("n"))
    return count("documents").unionAll(count("chunks")).unionAll(count("chunk_entities"))


# queue

_JOBS = """WITH j AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
 event_id % 4 AS attempt_count, ts AS updated_at, ts AS enqueued_at FROM events), now AS (SELECT max(ts) AS now FROM events)
"""


def _jobs(spark, d):
    e = B.read(spark, d, "events")
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("completed")
    j = e.select(F.col("event_id").alias("id"), status.alias("status"), (F.col("event_id") % 4).alias("attempt_count"), F.col("ts").alias("updated_at"), F.col("ts").alias("enqueued_at"), F.lit(None).cast("timestamp_ntz").alias("started_at"))
    return j, e.agg(F.max("ts")).first()[0]


@registered(_JOBS + "SELECT s AS status, count(j.id) AS n FROM (VALUES ('queued'), ('running'), ('completed'), ('failed')) v(s) LEFT JOIN j ON j.status = s GROUP BY 1")
def job_status_summary(spark, d):
    return jobs.summary(_jobs(spark, d)[0])


@registered(_JOBS + "SELECT id, 'running' AS status, attempt_count + 1 AS attempt_count, now AS updated_at FROM j, now WHERE status = 'queued' ORDER BY enqueued_at, id LIMIT 20")
def job_claim_fifo(spark, d):
    j, now = _jobs(spark, d)
    return jobs.claim(j, F.lit(now).cast("timestamp_ntz"), 20).select("id", "status", "attempt_count", "updated_at")


@registered(_JOBS + """SELECT id, attempt_count, CASE WHEN status = 'running' AND updated_at < now - INTERVAL 300 SECOND THEN CASE WHEN attempt_count < 3 THEN 'queued' ELSE 'failed' END ELSE status END AS status,
 CASE WHEN status = 'running' AND updated_at < now - INTERVAL 300 SECOND THEN now ELSE updated_at END AS updated_at FROM j, now""")
def job_reaper(spark, d):
    j, now = _jobs(spark, d)
    return jobs.reap(j, F.lit(now).cast("timestamp_ntz")).select("id", "attempt_count", "status", "updated_at")


@registered(_JOBS + "SELECT count(*) FILTER (status IN ('queued', 'running')) AS queue_depth FROM j")
def queue_depth(spark, d):
    return jobs.health(_jobs(spark, d)[0]).select("queue_depth")


@registered(_JOBS + "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def job_latest_state(spark, d):
    e = B.read(spark, d, "events").select(F.col("user_id").alias("id"), F.lit("queued").alias("status"), F.col("event_id").alias("attempt_count"), F.col("ts").alias("updated_at"))
    return jobs.latest(e).select(F.col("id").alias("user_id"), F.col("attempt_count").alias("event_id"))


# JSON, prompts, evaluation


@registered("SELECT event_id FROM events WHERE json_contains(props, '{\"k\": 3}')")
def json_filter_number(spark, d):
    return B.read(spark, d, "events").filter(jsonx.json_contains("props", {"k": 3})).select("event_id")


@registered("SELECT doc_id AS id FROM documents WHERE source = 'src3' AND lang = 'en'")
def json_filter_eq(spark, d):
    return B.documents(spark, d).filter(jsonx.json_contains("metadata", '{"source": "src3", "lang": "en"}')).select("id")


@registered("SELECT event_id, (props->>'k')::INT AS budget FROM events")
def json_settings_budget(spark, d):
    return B.read(spark, d, "events").select("event_id", jsonx.json_text("props", "k").cast("int").alias("budget"))


@registered("""
WITH RECURSIVE r AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, i, CASE WHEN t <= 60 THEN t ELSE 0 END AS used, CASE WHEN t <= 60 THEN [i] ELSE [] END AS kept FROM r WHERE i = 1
  UNION ALL SELECT r.conv_id, r.i, CASE WHEN used + t <= 60 THEN used + t ELSE used END, CASE WHEN used + t <= 60 THEN list_append(kept, r.i) ELSE kept END FROM f JOIN r ON r.conv_id = f.conv_id AND r.i = f.i + 1)
SELECT conv_id, array_to_string(arg_max(kept, i), ',') AS kept FROM f GROUP BY 1""")
def prompt_budget_fold(spark, d):
    c = B.read(spark, d, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).alias("tokens"))
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "tokens"))).alias("rows"))
    return rows.select("conv_id", F.array_join(ask.budget_fold("rows", 60).cast("array<string>"), ",").alias("kept"))


@registered(r"""
WITH a AS (SELECT doc_id, '[' || (doc_id % 7) || '] x [' || (doc_id % 5) || '] [' || (doc_id % 7) || '] [99]' AS t FROM documents),
f AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '\[(\d{1,9})\]', 1), lambda x: x::INT), lambda x: x BETWEEN 1 AND 5) AS l FROM a)
SELECT doc_id, coalesce((SELECT string_agg(v, ',' ORDER BY p) FROM (SELECT v, min(p) AS p FROM (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS p) GROUP BY v)), '') AS cited FROM f""")
def citations_extract(spark, d):
    k = lambda m: (F.col("doc_id") % m).cast("string")
    t = F.concat(F.lit("["), k(7), F.lit("] x ["), k(5), F.lit("] ["), k(7), F.lit("] [99]"))
    return B.read(spark, d, "documents").select("doc_id", F.array_join(text.citations(t, 5).cast("array<string>"), ",").alias("cited"))


@registered("""
WITH a AS (SELECT o_custkey % 50 AS q, o_orderkey % 40 AS c FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2), b AS (SELECT o_custkey % 50 AS q, o_orderkey % 40 AS c FROM orders WHERE o_totalprice > 200000 GROUP BY 1, 2),
i AS (SELECT coalesce(a.q, b.q) AS q, count(a.c) AS na, count(b.c) AS nb, count(*) FILTER (a.c IS NOT NULL AND b.c IS NOT NULL) AS k FROM a FULL JOIN b ON a.q = b.q AND a.c = b.c GROUP BY 1)
SELECT q AS query_id, round(k / (na + nb - k), 6) AS jaccard FROM i""")
def jaccard_topk(spark, d):
    o = B.read(spark, d, "orders").withColumns({"query_id": F.col("o_custkey") % 50, "chunk_id": F.col("o_orderkey") % 40})
    return evalx.agreement(o.filter("o_orderstatus = 'O'"), o.filter("o_totalprice > 200000")).select("query_id", SIX("jaccard").alias("jaccard"))


@registered("SELECT event_type, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS p95 FROM events GROUP BY 1")
def latency_percentile_formula(spark, d):
    w = W.partitionBy("event_type")
    e = B.read(spark, d, "events").select("event_type", "value")
    ranked = e.withColumn("i", F.row_number().over(w.orderBy("value")) - 1).withColumn("n", F.count("*").over(w))
    return ranked.filter(F.col("i") == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))).select("event_type", F.col("value").alias("p95"))


@registered()
def vector_ivf(spark, d):
    c = B.chunks(spark, d)
    centroids = ivf.train(c, ivf.lists_for(c.count()))
    return ivf.search(ivf.assign(c, centroids), B.row_queries(spark, d), centroids, ivf.probes_for(c, centroids))
