"""Column functions: vectors, texts, JSON, chunkers, resolution, credentials."""

import hashlib
import itertools
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphfuse import ask, evalx, providers, security
from graphfuse.functions import jsonx, stem, text, vector
from graphfuse.operators import chunking, resolve, tables
from graphfuse.schema import CryptoError, HttpError, InvalidConfig, Settings, profile_concurrency


def col(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def embed(t, dim):
    raw = b"".join(hashlib.sha256(t.encode() + struct.pack("<I", k)).digest() for k in range(-(-dim // 8)))
    v = (np.frombuffer(raw, "<u4")[:dim].astype(np.float64) / 4294967295 * 2 - 1).astype(np.float32)
    return v / np.linalg.norm(v)


@pytest.mark.parametrize("dim", [8, 64, 384])
def test_hash_embed(spark, dim):
    words = ["", "alpha", "é日本"]
    for w, v in zip(words, col(spark, words, "string", lambda x: vector.hash_embed(x, dim)), strict=True):
        assert np.allclose(v, embed(w, dim), atol=1e-6) and abs(np.linalg.norm(v) - 1) < 1e-5
    assert col(spark, [None], "string", lambda x: vector.hash_embed(x, dim)) == [None]


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0), ([0.0], [1.0], 0.0), (None, [1.0], None)]
    df = spark.createDataFrame([r[:2] for r in rows], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vector.cosine("a", "b")).collect()] == [r[2] for r in rows]
    assert col(spark, [[1.5, -2.0]], "array<float>", lambda x: vector.decode_vector(vector.encode_vector(x))) == [[1.5, -2.0]]


def test_texts(spark):
    assert col(spark, [None, "", " a  b\n", "\tx"], "string", text.token_count) == [0, 0, 2, 1]
    assert col(spark, ["", "A-b,C", None], "string", text.simple_tokens) == [[], ["a", "b", "c"], []]
    assert col(spark, [""], "string", text.content_hash) == [hashlib.sha256(b"").hexdigest()]
    assert col(spark, ["x [2] [1] [2] [99] [0]", None, "[5"], "string", lambda x: text.citations(x, 3)) == [[2, 1], [], []]
    df = spark.createDataFrame([("Acme Corp", "Acme Corp.")], "a string, b string")
    a, b = df.select(text.trigram_similarity("a", "b"), text.word_trigram_similarity("a", "b")).first()
    assert a < 1 and b == 1
    assert col(spark, [None, b"ok", b"\xff\xfe"], "binary", text.payload_kind) == ["path", "text", "bytes"]


def test_porter():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "formative": "form", "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "sky": "sky"}
    assert {w: stem.porter(w) for w in want} == want


def test_json_containment(spark):
    cases = [({"a": "x"}, {"a": "x", "b": 1}, True), ({"a": "1"}, {"a": 1}, False), ({"a": {"b": [1]}}, {"a": {"b": [2, 1]}}, True), ({"a": [3]}, {"a": [1]}, False), ({}, {"a": 1}, True), ({"a": True}, {"a": 1}, False)]
    import json

    for part, whole, want in cases:
        assert jsonx.contains(whole, part) is want
        assert col(spark, [json.dumps(whole)], "string", lambda x, p=part: jsonx.json_contains(x, p)) == [want]
    assert col(spark, [None], "string", lambda x: jsonx.json_contains(x, {"a": "b"})) == [False]
    assert jsonx.merge(None, {"p": 1}) == '{"p": 1}'


MARKED = "# One\n" + "First part. " * 12 + "\n# Two\nshort.\n# Three\n" + "Third part here. " * 10 + "\n# Four\ntiny.\n"


def test_chunkers(spark):
    docs = spark.createDataFrame([("m", MARKED), ("e", ""), ("n", None), ("h", "hello world"), ("w", " ".join(f"w{i}" for i in range(650)))], "document_id string, text string")
    n = lambda s, d: chunking.chunk(docs, s).filter(F.col("document_id") == d).count()
    assert (n("hierarchy", "m"), n("auto", "m"), n("sentence_aware", "m")) == (2, 4, 4)
    assert n("auto", "h") == 1 and n("auto", "e") == 0 and n("auto", "n") == 0
    w = chunking.chunk(docs, "fixed_overlap").filter("document_id = 'w'").orderBy("ord").collect()
    assert [r.token_count for r in w] == [300, 300, 300, 200, 50]
    assert chunking.strategy("Auto") == "auto" and chunking.strategy("nonsense") == "auto"
    with pytest.raises(InvalidConfig):
        chunking.chunk(docs, "semantic")
    assert all(r.token_count > 0 and len(r.text) <= 2000 for r in chunking.chunk(docs, "neighbor_expand").collect())
    assert {r.document_id for r in chunking.chunk_errors(docs, chunking.chunk(docs)).collect()} == {"e", "n"}


def grams(s):
    p = f"  {s.lower()}  "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def sim(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def test_canonical_is_the_sequential_greedy(spark):
    rng = random.Random(5)
    base = ["International Machines", "Acme Corp", "Blue Sky Holdings", "Northern Light"]
    names = []
    for i in range(60):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = rng.choice("abcdefg ")
        names.append((i, "".join(s)))
    leaders, want = [], {}
    for i, s in names:
        near = [(sim(s, t), -j) for j, t in leaders if sim(s, t) >= 0.6]
        if near:
            want[i] = -max(near)[1]
        else:
            leaders.append((i, s))
            want[i] = i
    df = spark.createDataFrame(names, "id long, name string")
    got = {r.id: r.canonical for r in resolve.canonical(df, 0.6, None).collect()}
    assert got == want


def greedy(names, t):
    leaders, out = [], {}
    for i, s in names:
        near = [(sim(s, u), -j) for j, u in leaders if sim(s, u) >= t]
        out[i] = -max(near)[1] if near else i
        if not near:
            leaders.append((i, s))
    return out


def test_canonical_of_numbered_names_and_copies(spark, monkeypatch):
    """Copies of a name aren't paired, and numbered names meet few others."""
    rng = random.Random(8)
    some = [f"Supplier#{rng.randrange(2000):09d}" for _ in range(150)] + ["", "a", "A b", "a" * 40, "International Business Machines Incorporated Worldwide 1", "International Business Machines Incorporated Worldwide 2"]
    names = [(i, rng.choice((s, s.upper()))) for i, s in enumerate(rng.choice(some) for _ in range(700))]
    seen = []

    def counting(rows, t, plain=resolve.trigram_pairs):
        seen.append(rows.count())
        return plain(rows, t)

    monkeypatch.setattr(resolve, "trigram_pairs", counting)
    df = spark.createDataFrame(names, "id long, name string")
    got = {r.id: r.canonical for r in resolve.canonical(df, 0.7, None).collect()}
    assert got == greedy(names, 0.7)
    assert seen == [len({s.lower() for _, s in names})]

    numbered = [(i, f"Supplier#{i:09d}") for i in range(1000, 3000)]
    met = []

    def pairing(sets, t, plain=resolve.meeting):
        met.append(plain(sets, t).count())
        return plain(sets, t)

    monkeypatch.undo()
    monkeypatch.setattr(resolve, "meeting", pairing)
    pairs = resolve.trigram_pairs(spark.createDataFrame(numbered, "id long, name string"), 0.7)
    own = {(r.a, r.b) for r in pairs.collect()}
    assert own == {(a, b) for (a, s), (b, u) in itertools.combinations(numbered, 2) if sim(s, u) >= 0.7}
    assert met[0] < 2000 * 1999 / 2 / 10, met


def test_merge_needs_both(spark):
    v = [0.5, 0.5, 0.1]
    ent = spark.createDataFrame([("e", "n", "International Business Machines", v)], "id string, namespace string, name string, name_emb array<float>")
    men = spark.createDataFrame([("same", "n", "International Business Machine", v), ("far", "n", "International Business Machines", [-x for x in v]), ("other", "m", "International Business Machines", v)], ent.schema)
    assert dict(map(tuple, resolve.merge_decision(men, ent).collect())) == {"same": "e", "far": None, "other": None}


def test_writes(spark):
    s = spark.createDataFrame([(1, "a", None), (2, "b", "k")], "id int, name string, kind string")
    rows = spark.createDataFrame([(3, "a", None), (4, "b", "k"), (5, "c", "k"), (6, "c", "k")], s.schema)
    assert {r.id for r in tables.new_rows(rows, s, ("name", "kind"), [F.col("id")]).collect()} == {3, 5}
    up = tables.upsert(s.select("id", "name"), rows.select("id", "name"), ("name",), [F.col("id")])
    assert {(r.id, r.name) for r in up.collect()} == {(3, "a"), (4, "b"), (6, "c")}


def test_budget_and_prompt(spark):
    fold = lambda t, b: spark.createDataFrame([(t,)], "r array<struct<tokens: int>>").select(ask.budget_fold("r", b)).first()[0]
    assert fold([(1000,), (2000,), (500,)], 1600) == [1, 3]
    assert fold([], 10) == []
    p = ask.build_prompt("q?", [("one", 1000), ("two", 2000), ("three", 500)], 1600)
    assert p.kept == [0, 2] and p.dropped == 1 and "[2] three" in p.text
    for passages, b in (([], 10), ([("x", 5000)], 4000), ([("x", 1)], 0)):
        with pytest.raises(InvalidConfig):
            ask.build_prompt("q", passages, b)
    hits = [{"chunk_id": f"id{i}", "document_id": "d", "text": f"t{i}", "token_count": 1} for i in range(2)]
    got = ask.answer("q", hits, providers.Mock("see [2], [1], [99]"))
    assert [c["chunk_id"] for c in got["citations"]] == ["id1", "id0"] and got["mode_used"] == "hybrid"
    assert ask.answer("q", [], providers.Mock())["citations"] == []


def test_providers():
    slept, calls = [], []

    def send(status):
        def f(url, body, head):
            calls.append(url)
            if len(calls) < 3:
                raise HttpError(status)
            return {"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3}}

        return f

    p = providers.Retrying(providers.OpenAI("m", "http://x", "k", send(429)), sleep=slept.append)
    assert p.complete("s", "p").text == "hi" and slept == [1.0, 2.0]
    calls.clear()
    with pytest.raises(HttpError):
        providers.Retrying(providers.OpenAI("m", "http://x", "k", send(400)), sleep=slept.append).complete("s", "p")
    assert len(calls) == 1
    e = providers.parse_extraction('x {"entities": [{"name": "A"}, {"kind": "b"}], "relationships": [{"src": "A", "dst": "B", "kind": "k"}, {"src": "A"}]} y')
    assert len(e.entities) == 1 and e.entities[0]["confidence"] == 1.0 and len(e.relationships) == 1
    assert providers.resolve("x", "y", []) == "x" and providers.resolve(None, "y", []) == "y"
    rows = [{"name": "b", "kind": "llm"}, {"name": "a", "kind": "embedding"}]
    assert providers.resolve(None, None, rows) == "b"
    with pytest.raises(providers.ProviderNotFound):
        providers.resolve(None, None, rows[1:])


def test_credentials(spark, tmp_path):
    key = bytes(range(32))
    c = security.encrypt(spark, "sécret", key)
    assert security.is_encrypted(c) and c.count(":") == 3 and security.decrypt(spark, c, key) == "sécret"
    assert security.encrypt(spark, "sécret", key) != c
    with pytest.raises(CryptoError):
        security.decrypt(spark, c, bytes(32))
    assert (security.redact("abc"), security.redact("abcdef")) == ("***", "abc***")
    assert security.redact_url("postgres://u:pw@h/d") == "postgres://u:***@h/d"
    f = tmp_path / "key"
    f.write_bytes(key)
    f.chmod(0o644)
    with pytest.raises(CryptoError):
        security.load_master_key(str(f))
    f.chmod(0o600)
    assert security.load_master_key(str(f)) == key


def test_settings_and_evaluation(spark):
    with pytest.raises(InvalidConfig):
        Settings(embed_dim=32)
    with pytest.raises(InvalidConfig):
        profile_concurrency("turbo")
    assert evalx.percentile([1, 2, 3, 4], 0.95) == 4
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "query_id int, chunk_id string")
    b = spark.createDataFrame([(1, "x"), (3, "q")], a.schema)
    assert {r.query_id: r.jaccard for r in evalx.agreement(a, b).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}


def test_similar_names_are_those_of_all_pairs(spark):
    """The prefix join against every pair, by namespace."""
    import random

    from graphfuse.operators import resolve

    rng = random.Random(4)
    name = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 9)))
    side = lambda k, n: [(f"{k}{i}", rng.choice("xy"), name()) for i in range(n)]
    m, e = side("m", 60), side("e", 80)
    grams = lambda t: {f"  {t.lower()}  "[i : i + 3] for i in range(len(t) + 2)}
    jac = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    frame = lambda rows: spark.createDataFrame(rows, "id string, namespace string, name string")
    for t in (0.3, 0.5, 0.85):
        got = {(r.mention_id, r.entity_id): round(r.similarity, 9) for r in resolve.similar(frame(m), frame(e), t).collect()}
        assert got == {(a[0], b[0]): round(jac(a[2], b[2]), 9) for a in m for b in e if a[1] == b[1] and jac(a[2], b[2]) >= t}
