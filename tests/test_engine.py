"""The store, ingest, queue and answers end to end."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphfuse import ingest
from graphfuse.engine import Engine
from graphfuse.providers import MockExtractor
from graphfuse.schema import CoreError, InvalidConfig, NamespaceNotFound, ProviderNotFound, Settings
from graphfuse.sources import fixture
from graphfuse.streaming import jobs


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store", Settings(embed_dim=64))


def test_ingest_query_ask_delete(engine):
    assert engine.ingest_text("a.txt", "Alice met Bob in Paris. They spoke of engines.") == "completed"
    assert engine.ingest_text("b.txt", "Alice met Bob in Paris. They spoke of engines.") == "skipped"
    assert engine.ingest_text("b.txt", "Alice met Bob in Paris. They spoke of engines.", "other") == "completed"
    assert engine.store.read("entities").count() == 0  # the mock provider extracts nothing
    rows = engine.query("engine").collect()
    assert len(rows) == 1 and rows[0].score > 0
    with pytest.raises(ProviderNotFound):
        engine.ask("engines?")
    engine.provider_create("m", "mock", credential="secret-key")
    assert engine.provider_list()[0]["credential"] == "sec***"
    got = engine.ask("engines?")
    assert [c["n"] for c in got["citations"]] == [1] and got["signals"]["llm"]["provider"] == "mock"
    engine.namespace_create("default", settings={"ask_token_budget": 1})
    with pytest.raises(InvalidConfig):
        engine.ask("engines?")
    doc = engine.store.read("documents").filter("namespace = 'default'").first().id
    assert engine.delete_document(doc) and not engine.delete_document(doc)
    assert engine.store.read("chunks").filter("namespace = 'default'").count() == 0
    assert engine.query("engine", namespace="other").count() == 1
    with pytest.raises(InvalidConfig):
        engine.ingest_bytes("x", b"\xff\xfe")
    with pytest.raises(InvalidConfig):
        engine.ingest_text("x", "  ")
    with pytest.raises(NamespaceNotFound):
        engine.namespace_drop("nowhere")


def test_extraction_links_and_merges(engine):
    engine.provider_create("x", "mock-extractor")
    engine.ingest_text("a", "Alice knows Bob. Carol waits.")
    ents = {r.name for r in engine.store.read("entities").collect()}
    assert ents == {"Alice", "Bob", "Carol"}
    assert engine.store.read("relationships").count() == 2
    engine.ingest_text("b", "Alice again, with Dora.")
    assert engine.store.read("entities").filter("name = 'Alice'").count() == 1
    assert engine.store.read("chunk_entities").count() == 5
    hits = engine.query("Alice", mode="graph", hops=1).collect()
    assert len(hits) == 2
    engine.delete_namespace("default")
    assert all(engine.store.read(t).count() == 0 for t in ("documents", "chunks", "entities", "relationships", "chunk_entities"))


def test_failure_leaves_nothing(engine, monkeypatch):
    class Broken(MockExtractor):
        def extract(self, text):
            raise RuntimeError("no service")

    monkeypatch.setattr("graphfuse.providers.build", lambda row, d=None: Broken())
    engine.provider_create("x", "mock")
    with pytest.raises(Exception, match="no service"):
        engine.ingest_text("a", "Some text.")
    assert engine.store.read("documents").count() == 0
    job = engine.submit("a", "Some text.")
    assert engine.run_queue() == 1
    assert engine.status(job).first().status == "failed" and engine.store.read("documents").count() == 0


def test_commit_is_atomic_and_batches_are_idempotent(engine, spark):
    rows = spark.createDataFrame([("c", "e", 1.0, "x")], "chunk_id string, entity_id string, confidence double, classification string")
    v = engine.store.commit(add={"chunk_entities": rows}, batch="b1")
    assert engine.store.commit(add={"chunk_entities": rows}, batch="b1") == v
    assert engine.store.read("chunk_entities").count() == 1
    bad = rows.withColumn("confidence", F.raise_error(F.lit("boom")).cast("double"))
    with pytest.raises(Exception, match="boom"):
        engine.store.commit(add={"chunk_entities": rows, "documents": rows.select(F.lit("i").alias("id")), "entities": bad.select(F.col("confidence").cast("string").alias("id"))})
    assert engine.store.read("chunk_entities").count() == 1 and engine.store.versions()[-1] == v
    assert engine.store.read("chunk_entities", v - 1).count() == 0


def record(kind, **c):
    return json.dumps({"kind": kind, **c})


def test_extracted_graph(engine, tmp_path):
    topics = ["t0", "t1", "t2", "t3", "t4"]
    lines = [record("_header", note="x")]
    for i in range(120):
        t = topics[i % 5]
        lines += [
            record("document", id=f"d{i}", namespace="n", source=f"s{i}", content_hash=f"h{i}"),
            record("chunk", id=f"c{i}", namespace="n", document_id=f"d{i}", ord=0, text="x", token_count=1, embedding=[0.1] * 4),
            record("entity", id=t, namespace="n", name=t, kind_label="topic", name_emb=[0.1] * 4),
            record("chunk_entity", chunk_id=f"c{i}", entity_id=t),
            "",
        ]
    lines += [record("relationship", id=f"r{i}", namespace="n", src_id=topics[i], dst_id=topics[i + 1], kind_label="next") for i in range(4)]
    f = tmp_path / "g.jsonl"
    f.write_text("\n".join(lines))
    assert engine.ingest_extracted(str(f), header=True) == 484
    n = {t: engine.store.read(t).count() for t in ("documents", "chunks", "entities", "chunk_entities", "relationships")}
    assert n == {"documents": 120, "chunks": 120, "entities": 5, "chunk_entities": 120, "relationships": 4}
    assert engine.store.read("documents").select("namespace").distinct().collect()[0][0] == "default"
    for bad in ("{", record("mystery"), '{"id": "x"}'):
        f.write_text(lines[1] + "\n" + bad)
        with pytest.raises(CoreError):
            engine.ingest_extracted(str(f))
    assert engine.store.read("documents").count() == 120


def test_defaults_of_records(spark):
    rows = spark.createDataFrame([(record("relationship", id="r", src_id="a", dst_id="b", kind_label="k"),), (record("chunk_entity", chunk_id="c", entity_id="e"),)], "value string")
    p = fixture.split(fixture.parse(rows))
    assert p["relationships"].first().weight == 1.0
    assert tuple(p["chunk_entities"].first())[2:] == (1.0, "extracted")


def test_queue_runs_each_job_once(engine, spark):
    when = datetime(2026, 1, 1)
    rows = [(f"j{i}", f"s{i}", None, bytearray(f"Text number {i}.".encode()), when + timedelta(seconds=i)) for i in range(50)] + [("bad", None, None, bytearray(b"\xff\xfe"), when)]
    df = spark.createDataFrame(rows, "id string, source string, chunk_strategy string, payload binary, enqueued_at timestamp")
    engine.enqueue(df.repartition(5))
    engine.run_queue()
    engine.run_queue()
    assert engine.store.read("documents").count() == 50
    assert dict(map(tuple, engine.status().collect())) == {"queued": 0, "running": 0, "completed": 50, "failed": 1}
    assert engine.status("bad").first().error == "not valid UTF-8" and engine.status("none").count() == 0
    h = engine.health().first()
    assert h.queue_depth == 0 and h.last_error == "not valid UTF-8"
    engine.enqueue(df.limit(1).withColumn("id", F.lit("again")))
    engine.run_queue()
    assert engine.store.read("documents").count() == 50


def test_queue_states_are_seen_and_stale_jobs_run_again(spark, tmp_path):
    """Submit, claim, lose the worker, reap, run: every state stands in the store, also for another engine on it."""
    path = f"file://{tmp_path}/store"
    engine = Engine(spark, path, Settings(embed_dim=64, job_reaper_interval=10))
    engine.provider_create("x", "mock-extractor")
    engine.namespace_create("n", "x", {"ingest_profile": "max"})
    a, b = engine.submit("a", "Alice knows Bob.", "n"), engine.submit("b", "   ", "n")
    other = Engine(spark, path, Settings(embed_dim=64, job_reaper_interval=10))
    states = lambda: dict(map(tuple, other.status().collect()))
    assert states()["queued"] == 2 and other.health().first().queue_depth == 2 and other.status(a).first().status == "queued"
    assert [r.id for r in engine.claim(1).collect()] == [a] and states()["running"] == 1
    assert [r.id for r in other.claim(5).collect()] == [b] and engine.claim() is None
    assert engine.run_queue() == 0  # both are another worker's
    old = jobs.latest(engine.store.read("ingest_jobs")).withColumn("updated_at", F.col("updated_at") - F.expr("interval 1 hour"))
    engine.store.commit(replace={"ingest_jobs": old})  # that worker was lost an hour ago
    assert other.reap() == 2 and states()["queued"] == 2
    assert other.run_queue() == 2
    assert states() == {"queued": 0, "running": 0, "completed": 1, "failed": 1}
    done = engine.status(a).first()
    assert (done.status, done.attempt_count) == ("completed", 2) and engine.status(b).first().error == "no chunks came from the content"
    # the queue extracts with the namespace's provider, known to every engine on the store
    assert {r.name for r in engine.store.read("entities").collect()} == {"Alice", "Bob"}
    assert [p["name"] for p in other.provider_list()] == ["x"] and other.provider_drop("x") and not engine.provider_drop("x")
    assert other._settings(other._namespace("n")).extract_concurrency == 16
    assert engine.store.compact() and states()["completed"] == 1


def test_serving_backs_off_and_reaps(engine, monkeypatch):
    monkeypatch.setattr(engine, "_work", lambda claimed: worked.extend(r.id for r in claimed.collect()))
    worked, waits, jobs_in = [], [], iter([None, "late"])

    def sleep(seconds):
        waits.append(seconds)
        if (name := next(jobs_in, None)) is not None:
            engine.submit(name, "text")

    first = engine.submit("first", "text")
    engine.serve(stop=lambda: len(waits) >= 4, sleep=sleep)
    assert worked[0] == first and len(worked) == 2 and waits == [1, 5, 1, 5]


def test_two_writers(engine, spark):
    from graphfuse.schema import Conflict

    rows = spark.createDataFrame([("c", "e", 1.0, "x")], "chunk_id string, entity_id string, confidence double, classification string")
    v = engine.store.versions()[-1]
    plain, seen = engine.store._publish, []

    def late(version, manifest):
        if not seen:
            seen.append(version)
            plain(version, engine.store.manifest(v))  # another writer comes first
        return plain(version, manifest)

    engine.store._publish = late
    assert engine.store.commit(add={"chunk_entities": rows}) == v + 2 and engine.store.read("chunk_entities").count() == 1
    with pytest.raises(Conflict):
        engine.store.commit(add={"chunk_entities": rows}, expect=v)
    assert engine.store.read("chunk_entities").count() == 1


def test_folder_intake(engine, spark, tmp_path):
    folder = f"file://{tmp_path}/drop"
    jobs.enqueue(spark.createDataFrame([("j1", "s", "default", bytearray(b"Dropped words."))], "id string, source string, namespace string, payload binary"), folder)
    engine.take_in(folder)
    engine.take_in(folder)
    assert engine.run_queue() == 1 and engine.status("j1").first().status == "completed"


def test_one_empty_file_is_an_error_of_its_own(engine, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Words here.")
    (tmp_path / "in" / "b.txt").write_text(" \n")
    with pytest.raises(InvalidConfig, match="b.txt"):
        engine.ingest(str(tmp_path / "in"))
    assert engine.store.read("documents").count() == 0


def test_credentials_in_the_store(spark, tmp_path):
    path, key = f"file://{tmp_path}/s", bytes(range(32))
    Engine(spark, path, Settings(embed_dim=64), key).provider_create("o", "openai", model="m", credential="top-secret")
    row = Engine(spark, path, Settings(embed_dim=64), key)._provider_rows()[0]
    assert row["credential"].startswith("enc:") and Engine(spark, path, Settings(embed_dim=64), key)._provider("o", None)
    plain = Engine(spark, f"{path}2", Settings(embed_dim=64))
    plain.provider_create("o", "openai", model="m", credential="top-secret")
    assert plain.store.read("providers").first().credential is None and plain.provider_list()[0]["credential"] == "top***"


def test_embedding_provider(engine, monkeypatch):
    from graphfuse.functions import onnx
    from graphfuse.functions.vector import hash_embed

    made = []
    monkeypatch.setattr(onnx, "onnx_embed", lambda c, *a: made.append(a) or hash_embed(F.lower(c if not isinstance(c, str) else F.col(c)), 64))
    engine.provider_create("e", "onnx", "embedding", model="/m.onnx", base_url="/t.json")
    engine.namespace_create("v", settings={"embedding_provider": "e"})
    engine.ingest_text("a", "SOME WORDS", "v")
    assert ("/m.onnx", "/t.json", 64) in made
    hit = engine.query("some words", namespace="v", mode="vector").first()
    assert hit.text == "SOME WORDS"
    engine.namespace_create("w", settings={"embedding_provider": "nobody"})
    with pytest.raises(ProviderNotFound):
        engine.ingest_text("a", "x", "w")


def test_job_states(spark):
    t0 = datetime(2026, 1, 1)
    rows = [("a", "running", 1, t0, None), ("b", "running", 3, t0, None), ("c", "completed", 1, t0, None), ("d", "running", 1, t0 + timedelta(seconds=900), None)]
    j = spark.createDataFrame(rows, "id string, status string, attempt_count int, updated_at timestamp, error string")
    now = F.lit(t0 + timedelta(seconds=1000))
    got = {r.id: r.status for r in jobs.reap(j, now).collect()}
    assert got == {"a": "queued", "b": "failed", "c": "completed", "d": "running"}
    assert [jobs.backoff(i) for i in range(6)] == [1, 5, 10, 20, 30, 30]
    q = spark.createDataFrame([(f"q{i}", "queued", 0, t0 + timedelta(seconds=i), None, None) for i in range(10)], "id string, status string, attempt_count int, enqueued_at timestamp, started_at timestamp, updated_at timestamp")
    c = jobs.claim(q, now, 3).collect()
    assert {r.id for r in c} == {"q0", "q1", "q2"} and all(r.status == "running" and r.attempt_count == 1 for r in c)


def test_plan_keeps_the_first_of_equal_contents(spark, engine):
    src = spark.createDataFrame([("n", "late", "same", 2), ("n", "early", "same", 1)], "namespace string, source string, text string, seq long")
    assert [r.source for r in ingest.new_documents(src, engine.store.read("documents").select("namespace", "content_hash")).collect()] == ["early"]


def test_paths_in_the_queue(engine, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("# Head\n" + "A file of words. " * 20)
    a = engine.submit(str(tmp_path / "in" / "a.txt"), strategy="hierarchy")
    b = engine.submit(str(tmp_path / "in" / "nowhere.txt"))
    c = engine.submit("inline", "Plain words here.", strategy="fixed_overlap")
    engine.run_queue()
    state = {k: engine.status(k).first() for k in (a, b, c)}
    assert [state[k].status for k in (a, b, c)] == ["completed", "failed", "completed"] and state[b].error == "no such file"
    assert engine.store.read("documents").count() == 2
    assert {r.chunk_id for r in engine.query("files", mode="bm25").collect()} == {r.id for r in engine.store.read("chunks").filter("text like '%file%'").collect()}


def test_reaper_over_the_store(engine, spark):
    old = datetime(2020, 1, 1)
    rows = [("a", "running", 1, old), ("b", "running", 3, old), ("c", "completed", 1, old)]
    engine.store.commit(add={"ingest_jobs": spark.createDataFrame(rows, "id string, status string, attempt_count int, updated_at timestamp")})
    assert engine.reap() == 2 and engine.reap() == 0
    assert dict(map(tuple, engine.status().collect())) == {"queued": 1, "running": 0, "completed": 1, "failed": 1}


def test_sql_functions(engine, spark):
    r = spark.sql("SELECT token_count(' a  b ') n, trgm_similarity('Acme', 'ACME') s, cosine_distance(embed('x'), embed('x')) d, size(embed('x')) k").first()
    assert r.n == 2 and r.s == 1.0 and abs(r.d) < 1e-6 and r.k == 64
    from graphfuse.functions.vector import hash_embed

    both = spark.range(1).select(F.expr("embed('é')").alias("a"), hash_embed(F.lit("é"), 64).alias("b")).first()
    assert both.a == pytest.approx(both.b)
    got = spark.sql("SELECT d.id, c.ord, c.text FROM (SELECT 1 id, 'One. Two.' t) d, LATERAL chunk_text(d.t) c").collect()
    assert [tuple(r) for r in got] == [(1, 0, "One. Two.")]


def test_index_is_read_by_word(engine):
    engine.ingest_text("a", "Alpha beta gamma.")
    engine.ingest_text("b", "Delta epsilon.")
    plan = engine.query("alphas", mode="bm25")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(lexeme,alpha)" in plan or "In(lexeme" in plan or "lexeme IN" in plan or "lexeme#" in plan
    assert engine.query("alphas", mode="bm25").count() == 1


def test_onnx_encoder():
    import numpy as np

    from graphfuse.functions.onnx import Encoder

    class Tok:
        def enable_truncation(self, n): ...
        def enable_padding(self): ...
        def encode_batch(self, texts):
            n = max(map(len, texts))
            return [type("E", (), {"ids": [ord(c) for c in t.ljust(n)], "attention_mask": [1] * n}) for t in texts]

    run = lambda feed: np.repeat(feed["input_ids"][:, :, None], 4, axis=2).astype(np.float32)
    v = Encoder("", "", 4, run=run, tokenizer=Tok())(["ab", "c"])
    assert v.shape == (2, 4) and np.allclose(np.linalg.norm(v, axis=1), 1)
    with pytest.raises(InvalidConfig):
        Encoder("", "", 5, run=run, tokenizer=Tok())(["ab"])


def test_stored_index(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    exact, near = Engine(spark, path, Settings(embed_dim=64)), Engine(spark, path, Settings(embed_dim=64, exact=False))
    rows = [(f"s{i}", f"Sentence number {i} about things.") for i in range(60)]
    from graphfuse.sources import files

    assert exact._ingest(files.inline(spark, rows), "default", None) == "completed"
    assert near._near() is None  # nothing is built yet
    assert exact.build_index() == 8 and exact._near() is None and near._near() is not None
    near.ingest_text("late", "A late sentence.")
    for q in ("Sentence number 7 about things.", "A late sentence."):
        assert near.query(q, mode="vector", top_k=1).first().text == q
    want = {r.chunk_id for r in exact.query("Sentence number 7 about things.", mode="vector", top_k=20).collect()}
    got = {r.chunk_id for r in near.query("Sentence number 7 about things.", mode="vector", top_k=20).collect()}
    assert len(want & got) >= 16
    doc = exact.store.read("documents").filter("source = 's7'").first().id
    exact.delete_document(doc)
    assert near.query("Sentence number 7 about things.", mode="vector", top_k=1).first().text != "Sentence number 7 about things."
