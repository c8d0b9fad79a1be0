"""The engine: one object over a store, with the functions a user calls."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ask as asking
from . import ingest as ingesting
from . import providers, security
from .functions import jsonx, onnx, stem, text, vector
from .operators import fusion, ivf, lanes
from .operators import tables as T
from .schema import DEFAULT_BUDGET, LANE_LIMIT, TABLES, Conflict, InvalidConfig, NamespaceNotFound, ProviderNotFound, Settings, profile_concurrency
from .sources import files, fixture
from .sources.store import Store
from .streaming import jobs


#: Jobs that a worker claims at once.
JOBS_AT_ONCE = 64


class Engine:
    """Retrieval, ingest and administration over a store of Parquet tables.

    Providers are rows of the store.  A credential is stored encrypted if there is
    a master key, and is decrypted at the moment of use; without a key it stays
    with this driver and is never stored.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), master_key: bytes | None = None):
        self.spark, self.store, self.settings = spark, Store(spark, path), settings
        self._key = master_key
        self._secrets: dict[str, str] = {}
        self._path = path.rstrip("/")
        if not self.store.versions():
            self.store.commit(replace={"namespaces": self._namespace_rows("default")})
        register(spark, settings)

    # namespaces

    def _namespace_rows(self, name: str, llm: str | None = None, settings: dict | None = None, model: str = "bge-small-en-v1.5") -> DataFrame:
        return self.spark.createDataFrame([(name, model, llm, json.dumps(settings or {}))], "name string, embedding_model string, llm_provider string, settings string").withColumn("created_at", F.current_timestamp())

    def _namespace(self, name: str) -> dict | None:
        r = self.store.read("namespaces").filter(F.col("name") == name).first()
        return r.asDict() if r else None

    def namespace_create(self, name: str, llm_provider: str | None = None, settings: dict | None = None) -> None:
        rows = self._namespace_rows(name, llm_provider, settings)
        self.store.commit(replace={"namespaces": T.upsert(self.store.read("namespaces"), rows, ("name",), [F.col("created_at")])})

    def namespace_drop(self, name: str, cascade: bool = False) -> None:
        if self._namespace(name) is None:
            raise NamespaceNotFound(name)
        self.store.commit(replace=T.delete_namespace(self.store.tables(), name, cascade))

    def set_ingest_profile(self, namespace: str, profile: str) -> None:
        profile_concurrency(profile)
        ns = self._namespace(namespace)
        if ns is None:
            raise NamespaceNotFound(namespace)
        self.namespace_create(namespace, ns["llm_provider"], json.loads(jsonx.merge(ns["settings"], {"ingest_profile": profile})))

    # providers

    def provider_create(self, name: str, provider: str, kind: str = "llm", model: str | None = None, base_url: str | None = None, credential: str | None = None) -> None:
        """kind ``llm``, or ``embedding`` (``hash``, or ``onnx`` with the model's path as model and the tokeniser's as base_url)."""
        if kind not in ("llm", "embedding"):
            raise InvalidConfig("a provider is of kind llm or embedding")
        if kind == "embedding" and provider not in ("hash", "onnx"):
            raise InvalidConfig(f"unknown embedding provider {provider!r}; known: hash, onnx")
        self._secrets.pop(name, None)
        if credential and self._key:
            credential = security.encrypt(self.spark, credential, self._key)
        elif credential:
            self._secrets[name], credential = credential, None
        row = self.spark.createDataFrame([(name, kind, provider, model, base_url, credential)], TABLES["providers"])
        self.store.commit(replace={"providers": T.upsert(self.store.read("providers"), row, ("name",), [])})

    def provider_drop(self, name: str) -> bool:
        known = self.store.read("providers")
        if known.filter(F.col("name") == name).isEmpty():
            return False
        self._secrets.pop(name, None)
        self.store.commit(replace={"providers": known.filter(F.col("name") != name)})
        return True

    def _provider_rows(self) -> list[dict]:
        rows = [r.asDict() for r in self.store.read("providers").orderBy("name").collect()]
        return [p | {"credential": p["credential"] or self._secrets.get(p["name"])} for p in rows]

    def provider_list(self) -> list[dict]:
        shown = lambda c: None if c is None else security.redact(c)
        return [p | {"credential": shown(p["credential"])} for p in self._provider_rows()]

    def _provider(self, explicit: str | None, ns: dict | None) -> providers.Provider:
        rows = self._provider_rows()
        name = providers.resolve(explicit, ns and ns["llm_provider"], rows)
        row = next((p for p in rows if p["name"] == name), None)
        if row is None:
            raise ProviderNotFound(name)
        key = self._key
        return providers.build(row, (lambda t: security.decrypt(self.spark, t, key)) if key else None)

    def _extractor(self, ns: dict | None) -> providers.Provider:
        """The namespace's provider, or one that extracts nothing where there is none."""
        try:
            return self._provider(None, ns)
        except ProviderNotFound:
            return providers.Mock()

    def _embedder(self, ns: dict | None) -> Callable[[str], Column]:
        """What makes vectors in a namespace: its setting ``embedding_provider``, else the hash embedding."""
        dim = self.settings.embed_dim
        name = json.loads(ns["settings"] or "{}").get("embedding_provider") if ns else None
        if name is None:
            return lambda c: vector.hash_embed(c, dim)
        row = next((p for p in self._provider_rows() if p["name"] == name and p["kind"] == "embedding"), None)
        if row is None:
            raise ProviderNotFound(name)
        if row["provider"] == "hash":
            return lambda c: vector.hash_embed(c, dim)
        return lambda c: onnx.onnx_embed(c, row["model"], row["base_url"], dim)

    def _settings(self, ns: dict | None) -> Settings:
        """The engine's settings with the namespace's ingest profile."""
        profile = json.loads(ns["settings"] or "{}").get("ingest_profile") if ns else None
        return self.settings if profile is None else replace(self.settings, extract_concurrency=profile_concurrency(profile))

    # ingest

    def ingest_text(self, name: str, content: str | bytes, namespace: str = "default", strategy: str | None = None) -> str:
        """Ingest now; ``completed`` or ``skipped`` for content that the namespace has."""
        return self._ingest(files.inline(self.spark, [(name, content)]), namespace, strategy)

    ingest_bytes = ingest_text

    def ingest(self, path: str, namespace: str = "default", strategy: str | None = None) -> str:
        """Ingest a file, or every file of a folder."""
        return self._ingest(files.read_files(self.spark, path), namespace, strategy)

    def _ingest(self, sources: DataFrame, namespace: str, strategy: str | None, batch: str | None = None) -> str:
        ns = self._namespace(namespace)
        bad = sources.filter("error is not null").select("source", "error").first()
        if bad:
            raise InvalidConfig(f"{bad['source']}: {bad['error']}")
        rows = sources.withColumns({"namespace": F.lit(namespace), "seq": F.xxhash64("source")}).drop("content", "error")
        save = self._saver()
        add = ingesting.plan(self.spark, rows, self.store.tables(), strategy, self._extractor(ns), self._settings(ns), save, self._embedder(ns))
        none = [r[0] for r in add.pop("empty").select("source").limit(10).collect()]
        if none:
            raise InvalidConfig(f"no chunks came from the content of {', '.join(none)}")
        if add["documents"].isEmpty():
            return "skipped"
        self.store.commit(add=self._indexed(add), batch=batch)
        return "completed"

    def _saver(self):
        """Cuts lineage by a table in the store's own folder."""
        top = f"{self._path}/_tmp/{uuid.uuid4().hex}"
        n = iter(range(1_000_000))

        def save(df: DataFrame) -> DataFrame:
            path = f"{top}/{next(n)}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        return save

    def ingest_extracted(self, path: str, namespace: str = "default", header: bool = False) -> int:
        """Load a JSON-lines graph; returns the number of records read."""
        n, add = fixture.load(self.spark, path, self.store.tables(), namespace, header)
        self.store.commit(add=self._indexed(add))
        return n

    def delete_document(self, document_id: str) -> bool:
        tables = self.store.tables()
        ids = tables["documents"].filter(F.col("id") == document_id).select("id")
        if ids.isEmpty():
            return False
        out = T.delete_documents(tables, ids)
        self.store.commit(replace={t: out[t] for t in ("documents", "chunks", "chunk_entities", "postings")})
        return True

    def delete_namespace(self, name: str) -> None:
        self.store.commit(replace=T.delete_namespace(self.store.tables(), name, True))

    # retrieval

    def graph(self) -> fusion.Graph:
        t = self.store.tables()
        return fusion.Graph(t["chunks"], t["entities"], t["relationships"], t["chunk_entities"], t["postings"])

    def build_index(self) -> int:
        """Store an inverted-file index of all chunks; returns its number of lists.

        Used by queries where the setting ``exact`` is off.  Chunks that come later
        are searched exactly beside it, until it is built anew.
        """
        chunks = self.store.read("chunks")
        centroids = ivf.train(chunks, ivf.lists_for(chunks.count()))
        if not len(centroids):
            return 0
        probes = ivf.probes_for(chunks, centroids)
        rows = self.spark.createDataFrame([(k, [float(v) for v in c], probes) for k, c in enumerate(centroids)], TABLES["centroids"])
        self.store.commit(replace={"vector_lists": ivf.assign(chunks, centroids), "centroids": rows})
        return len(centroids)

    def _near(self) -> Callable[..., DataFrame] | None:
        """The vector lane by the stored index, where there is one and answers needn't be exact."""
        rows = [] if self.settings.exact else self.store.read("centroids").orderBy("list").collect()
        if not rows:
            return None
        centroids, probes, index = np.array([r.centroid for r in rows]), rows[0].probes, self.store.read("vector_lists")

        def lane(chunks: DataFrame, queries: DataFrame, metadata_filter=None, limit: int = LANE_LIMIT) -> DataFrame:
            own = lanes.allowed(chunks, metadata_filter)
            held = index.join(own.select("id"), "id", "left_semi")  # rows may have gone since
            late = lanes.vector_lane(own.join(index.select("id"), "id", "left_anti"), queries, None, limit)
            found = ivf.search(held, queries, centroids, probes, limit)
            return lanes.ranked(found.unionByName(late).drop("rk"), [F.col("distance").asc_nulls_last()], limit)

        return lane

    def _indexed(self, add: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The postings of the chunks that are added."""
        chunks = add["chunks"]
        vocab = stem.vocabulary(chunks.select(F.explode(text.simple_tokens("text")).alias("token")))
        return add | {"postings": lanes.postings(chunks, vocab)}

    def query(self, q: str, filter: dict | str | None = None, top_k: int = 10, namespace: str = "default", hops: int = 1, weights: dict | None = None, mode: str = "hybrid") -> DataFrame:
        """(chunk_id, document_id, text, score, signals) for one question."""
        one = self.spark.createDataFrame([(0, q, namespace)], "query_id int, q string, namespace string").withColumn("q_emb", self._embedder(self._namespace(namespace))("q"))
        return self.query_batch(one, filter, top_k, hops, weights, mode).drop("query_id")

    def query_batch(self, queries: DataFrame, filter: dict | str | None = None, top_k: int = 10, hops: int = 1, weights: dict | None = None, mode: str = "hybrid", batch: bool = False) -> DataFrame:
        """(query_id, …) for a frame of questions (query_id, q, q_emb, namespace)."""
        return fusion.retrieve(self.graph(), queries, mode, top_k, hops, weights, filter, english=True, batch=batch, near=self._near())

    def ask(self, q: str, filter: dict | str | None = None, top_k: int = 10, namespace: str = "default", hops: int = 1, llm_provider: str | None = None) -> dict:
        """{answer, citations, signals, mode_used}; without any provider an error."""
        ns = self._namespace(namespace)
        provider = self._provider(llm_provider, ns)
        hits = self.query(q, filter, top_k, namespace, hops).join(self.store.read("chunks").select(F.col("id").alias("chunk_id"), "token_count"), "chunk_id")
        rows = [r.asDict() for r in hits.orderBy(F.col("score").desc(), "chunk_id").collect()]
        told = json.loads(ns["settings"] or "{}").get("ask_token_budget") if ns else None
        return asking.answer(q, rows, provider, int(told) if told is not None else DEFAULT_BUDGET)

    # jobs

    def enqueue(self, rows: DataFrame) -> None:
        """Put jobs (id, source, namespace, chunk_strategy, payload, enqueued_at) in the queue."""
        self.store.commit(add={"ingest_jobs": jobs.queued(rows, F.current_timestamp())})

    def submit(self, source: str, content: str | bytes | None = None, namespace: str = "default", strategy: str | None = None) -> str:
        """Put one job in the queue and return its id; without content the source is a path."""
        job = str(uuid.uuid4())
        raw = None if content is None else bytearray(content.encode() if isinstance(content, str) else content)
        self.enqueue(self.spark.createDataFrame([(job, source, namespace, strategy, raw)], "id string, source string, namespace string, chunk_strategy string, payload binary"))
        return job

    def take_in(self, folder: str, once: bool = True):
        """Queue the jobs of files dropped into a folder, each file once; returns the stream unless ``once``."""

        def handle(batch: DataFrame, batch_id: int) -> None:
            self.store.commit(add={"ingest_jobs": jobs.queued(batch, F.current_timestamp())}, batch=f"{folder} {batch_id}")

        stream = jobs.worker(self.spark, folder, f"{self._path}/_intake/{uuid.uuid5(uuid.NAMESPACE_URL, folder)}", handle, once)
        if once:
            stream.awaitTermination()
        return None if once else stream

    def claim(self, most: int = JOBS_AT_ONCE) -> DataFrame | None:
        """Set the oldest queued jobs running, for this worker alone; None if there are none."""
        while True:
            version = self.store.versions()[-1]
            log = jobs.latest(self.store.read("ingest_jobs", version))
            got = self._saver()(jobs.claim(log, F.current_timestamp(), most))
            if got.isEmpty():
                return None
            try:
                self.store.commit(add={"ingest_jobs": got}, expect=version)
                return got
            except Conflict:
                continue

    def run_queue(self, most: int = JOBS_AT_ONCE) -> int:
        """Work off what is queued, stale jobs of lost workers too; returns the number of jobs."""
        done = 0
        self.reap()
        while (claimed := self.claim(most)) is not None:
            self._work(claimed)
            done += claimed.count()
        return done

    def serve(self, stop: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> None:
        """Work until ``stop`` says so: poll, back off while idle, and reap now and then."""
        idle, reaped = 0, 0.0
        while not stop():
            if time.monotonic() - reaped >= self.settings.job_reaper_interval:
                self.reap()
                reaped = time.monotonic()
            claimed = self.claim()
            if claimed is None:
                sleep(jobs.backoff(idle))
                idle += 1
                continue
            idle = 0
            self._work(claimed)

    def _work(self, claimed: DataFrame) -> None:
        """Ingest claimed jobs; their rows and their final states are one commit.

        Jobs of one namespace and strategy go together, with that namespace's
        providers and profile; if they fail they fail together, and nothing of
        theirs is added.
        """
        save = self._saver()
        src = save(self._with_files(jobs.to_sources(claimed)))
        ok = src.filter("error is null and text is not null").withColumn("seq", F.unix_micros("seq"))
        add: dict[str, list[DataFrame]] = {}
        failed = [src.select("id", F.coalesce("error", F.when(F.col("text").isNull(), F.lit("no content"))).alias("why")).filter("why is not null")]
        stored = self.store.tables()
        for namespace, strategy in sorted(map(tuple, ok.select("namespace", "chunk_strategy").distinct().collect())):
            own = ok.filter((F.col("namespace") == namespace) & (F.col("chunk_strategy") == strategy))
            held = {t: reduce(DataFrame.unionByName, [df, *add.get(t, [])]) for t, df in stored.items()}
            try:
                ns = self._namespace(namespace)
                more = ingesting.plan(self.spark, own.select("namespace", "source", "text", "seq"), held, strategy, self._extractor(ns), self._settings(ns), save, self._embedder(ns))
                empty = more.pop("empty").select("content_hash")
                more = {t: save(_as(df, stored[t])) for t, df in self._indexed(more).items()}
            except Exception as e:  # a provider's or a setting's fault is these jobs' error, not the worker's
                failed.append(save(own.select("id", F.lit(f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"[:500]).alias("why"))))
                continue
            hashed = own.select("id", text.content_hash("text").alias("content_hash"))
            failed.append(hashed.join(empty, "content_hash", "left_semi").select("id", F.lit("no chunks came from the content").alias("why")))
            for t, df in more.items():
                add.setdefault(t, []).append(df)
        why = reduce(DataFrame.unionByName, failed)
        done = jobs.finish(claimed.drop("error").join(why, "id", "left"), F.current_timestamp(), F.col("why")).drop("why")
        self.store.commit(add={**{t: reduce(DataFrame.unionByName, dfs) for t, dfs in add.items()}, "ingest_jobs": done})

    def _with_files(self, src: DataFrame) -> DataFrame:
        """Texts of the jobs that name a path; a path that isn't there is an error."""
        named = src.filter("kind = 'path'")
        paths = [r[0] for r in named.select("source").distinct().collect()]
        if not paths:
            return src
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        full = {}
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            fs = path.getFileSystem(conf)
            if fs.exists(path):
                full[p] = fs.makeQualified(path).toString()
        places = self.spark.createDataFrame(list(full.items()), "source string, place string")
        found = files.decoded(self.spark.read.format("binaryFile").load(sorted(full.values())).select(F.col("path").alias("source"), "content")) if full else None
        if found is None:
            read = places.select("source", F.lit(None).cast("string").alias("t"), F.lit(None).cast("string").alias("e"))
        else:
            read = places.join(found.select(F.col("source").alias("place"), F.col("text").alias("t"), F.col("error").alias("e")), "place").drop("place")
        whole = named.drop("text", "error").join(read, "source", "left")
        whole = whole.withColumns({"text": F.col("t"), "error": F.when(F.col("t").isNull() & F.col("e").isNull(), "no such file").otherwise(F.col("e"))}).drop("t", "e")
        return src.filter("kind <> 'path'").unionByName(whole)

    def reap(self) -> int:
        """Requeue or fail running jobs that have gone stale; returns their number."""
        log = jobs.latest(self.store.read("ingest_jobs"))
        swept = jobs.reap(log, F.current_timestamp(), self.settings.job_reaper_interval, self.settings.max_attempts)
        changed = self._saver()(swept.alias("n").join(log.select("id", F.col("status").alias("old")), "id").filter("status <> old").drop("old"))
        n = changed.count()
        if n:
            self.store.commit(add={"ingest_jobs": changed})
        return n

    def status(self, job_id: str | None = None) -> DataFrame:
        """State counts, or the one job's row (none for an unknown id)."""
        log = jobs.latest(self.store.read("ingest_jobs"))
        return jobs.summary(log) if job_id is None else log.filter(F.col("id") == job_id)

    def health(self) -> DataFrame:
        return jobs.health(jobs.latest(self.store.read("ingest_jobs")), self.settings)


def _as(df: DataFrame, like: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])


def embed_sql(dim: int) -> str:
    """``vector.hash_embed`` as the body of a SQL function of ``t``."""
    digests = ", ".join(f"sha2(concat(encode(t, 'UTF-8'), unhex('{k.to_bytes(4, 'little').hex()}')), 256)" for k in range(-(-dim // 8)))
    at = lambda k: f"substring(h, i * 8 + {2 * k + 1}, 2)"
    word = f"cast(cast(conv(concat({at(3)}, {at(2)}, {at(1)}, {at(0)}), 16, 10) AS DOUBLE) / 4294967295D * 2 - 1 AS FLOAT)"
    raw = f"transform(array(concat({digests})), h -> transform(sequence(0, {dim - 1}), i -> {word}))[0]"
    norm = "sqrt(aggregate(v, 0D, (s, x) -> s + cast(x AS DOUBLE) * cast(x AS DOUBLE)))"
    return f"transform(array({raw}), v -> transform(v, x -> cast(cast(x AS DOUBLE) / {norm} AS FLOAT)))[0]"


class ChunkText:
    """Table function: the chunks (ord, text, token_count) of one text."""

    def eval(self, content: str):  # noqa: D102
        from .operators.chunking import sentence_aware

        for k, c in enumerate(sentence_aware(content or "")):
            yield k, c, len(c.split())


def register(spark: SparkSession, settings: Settings = Settings()) -> None:
    """The scalar functions, and the chunker, as temporary SQL functions."""
    put = lambda head, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    put("token_count(t STRING) RETURNS INT", r"size(filter(split(coalesce(t, ''), '\\s+'), w -> w <> ''))")
    put("content_hash(t STRING) RETURNS STRING", "sha2(t, 256)")
    put("vector_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE", "aggregate(zip_with(a, b, (x, y) -> cast(x AS DOUBLE) * cast(y AS DOUBLE)), 0D, (s, v) -> s + v)")
    put("cosine_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE", "1D - vector_dot(a, b) / (sqrt(vector_dot(a, a)) * sqrt(vector_dot(b, b)))")
    put("name_trigrams(t STRING) RETURNS ARRAY<STRING>", "array_distinct(transform(sequence(1, length(t) + 2), i -> substring(concat('  ', lower(t), '  '), i, 3)))")
    put("trgm_similarity(a STRING, b STRING) RETURNS DOUBLE", "size(array_intersect(name_trigrams(a), name_trigrams(b))) / size(array_union(name_trigrams(a), name_trigrams(b)))")
    put("embed(t STRING) RETURNS ARRAY<FLOAT>", embed_sql(settings.embed_dim))
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="ord int, text string, token_count int"))


__all__ = ["Engine", "lanes", "register", "text"]
