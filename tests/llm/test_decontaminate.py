"""Leaks of benchmark items: exact search by brute force, recall under edits, license digests, the pipeline."""

import random

import numpy as np

from graphfuse.llm import decontaminate as D
from graphfuse.llm import licenses
from tests.oracle import duck, same


def edits(a, b):
    """Least edits of ``a`` to any part of ``b``."""
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def test_search_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
        b = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 25)))
        want = edits(a, b)
        got = D.search(a, b, want)
        assert got is not None and got[0] == want
        if want:
            assert D.search(a, b, want - 1) is None


def items(rng, n=20):
    return [(i, " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(30))) for i in range(n)]


def spoiled(rng, t, k):
    b = list(t)
    for _ in range(k):
        p = rng.randrange(len(b))
        b[p : p + 1] = rng.choice([[], [rng.choice("etaoin")], [b[p], rng.choice("etaoin")]])
    return "".join(b)


def test_recall_under_edits():
    rng = random.Random(2)
    known = items(rng)
    index = D.Index(known)
    prose = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(40))
    for share, least in ((0, 1.0), (0.03, 1.0), (0.07, 0.95)):
        hits = 0
        for _ in range(60):
            i, t = rng.choice(known)
            x = np.frombuffer((prose() + " " + spoiled(rng, t, int(share * len(t))) + " " + prose()).encode(), np.uint8)
            hits += any(r[1] == i for r in D.leaks(index, x, np.array([0, len(x)])))
        assert hits / 60 >= least
    clean = np.frombuffer(" ".join(prose() for _ in range(200)).encode(), np.uint8)
    assert list(D.leaks(index, clean, np.array([0, len(clean)]))) == []


def test_rows_and_edges(docs, spark):
    rng = random.Random(3)
    known = items(rng, 5)
    bench = spark.createDataFrame([*known, (77, None), (78, ""), (79, "short"), (80, "seventeen letters!")], "item_id long, text string")
    a, b = known[0][1], known[1][1]
    rows = [(1, f"x {a} y"), (2, a.upper().replace(" ", "\n  ")), (3, None), (4, ""), (5, "filler words " * 3000 + b), (6, a[: len(a) // 2]), (7, f"{a} | {a} | {b}"), (8, "so seventeen letters! it is"), (9, a), (9, a)]
    df = docs(rows, extra=True)
    for block in (2, 1000):
        got = D.find_leaks(df, bench, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 0), (2, 0), (5, 1), (7, 0), (7, 1), (8, 80), (9, 0)}
    one = [r for r in got if r.doc_id == 1][0]
    assert rows[0][1].encode()[one.start : one.stop].decode() == a and one.edits == 0
    assert len([r for r in got if r.doc_id == 7]) == 3
    assert {r.doc_id for r in D.clean(df, bench).collect()} == {3, 4, 6}
    assert D.clean(df, bench).columns == df.columns
    assert D.find_leaks(docs([]), bench).count() == 0
    assert D.find_leaks(df, bench.limit(0)).count() == 0


def test_leak_at_the_joint_of_two_texts_is_none(docs, spark):
    rng = random.Random(4)
    (i, t), = items(rng, 1)
    bench = spark.createDataFrame([(i, t)], "item_id long, text string")
    half = len(t) // 2
    assert D.find_leaks(docs([(1, t[:half]), (2, t[half:])]).coalesce(1), bench).count() == 0


def test_license_digests(docs, spark, sf_dir):
    mit = licenses.KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENSE") + "\n"), (2, "text\nReleased under the MIT Licence!\nmore\nLicensed under CC BY 4.0"),
        (3, None), (4, ""), (5, "nothing here"), (6, "released under the mit license"), (7, mit + " and more"), (7, mit + " and more"), (None, "x"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(rows, extra=True)).collect()}
    assert got[1].text_license == "MIT" and got[7].text_license is None
    assert (got[2].n_notices, got[2].notices) == (2, "CC-BY-4.0,MIT")
    assert got[6].text_license == "MIT" and got[3].digest == got[4].digest and got[5].n_notices == 0
    assert licenses.scan_licenses(docs([])).count() == 0
    from graphfuse.llm.queries import queries

    same(queries()["op3_license_digests"](spark, sf_dir), duck(sf_dir), licenses.oracle_sql())
    # the dialects agree on line ends and letters beyond ASCII
    import duckdb

    odd = [(i, f"{a}Copyright 2020 Foo{b}hello{c}Released under the MİT License{b}Released under the mit licence.") for i, (a, b, c) in enumerate([("Hello\r", "\r", "\r"), ("x\r\n", "\r\n", "\n"), ("\u2028", "\u0085", "\u2029"), ("\u212a\n", "\n\r", "\v")])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", odd)
    same(licenses.scan_licenses(docs(odd)), con, licenses.oracle_sql())


def test_license_texts_of_a_folder(docs, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Take it.\nKeep this sentence.\n")
    known = licenses.KNOWN + licenses.texts_of(tmp_path)
    rows = [(1, "Copyright 1999 X\nTAKE IT -- keep this sentence"), (2, licenses._ZLIB)]
    assert {r.doc_id: r.text_license for r in licenses.scan_licenses(docs(rows), known).collect()} == {1: "Own-1.0", 2: "Zlib"}


def test_license_plan_is_native(docs):
    plan = licenses.scan_licenses(docs([(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P
    from tests.llm.test_near_dup import brute

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = {}
    docs = documents
    from graphfuse.llm.cluster import Scratch

    scratch = Scratch(spark, "test")
    for name, stage in P.STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        frames[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == documents.columns
    rows = [(r.doc_id, r.text) for r in frames["quality_rules"].collect()]
    assert {r.doc_id for r in frames["minhash_near_dedup"].collect()} == {i for i, (_, c) in brute(rows).items() if i == c}
    left = {r.doc_id: r.text for r in frames["suffix_array_dedup"].collect()}
    for r in frames["minhash_near_dedup"].collect():
        assert len(left[r.doc_id]) <= len(r.text)
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(b in r.text for r in frames["decontamination"].collect() for b in bench)
    n = frames["packing"].selectExpr("count(distinct doc_id)").first()[0]
    assert n == frames["decontamination"].count()
    assert P.run(spark, sf_dir).count() == frames["packing"].count()


def test_pipeline_edges(docs, spark, sf_dir):
    import corpus_pipeline as P

    for rows in ([], [(1, None), (None, "a b"), (2, "")]):
        d = docs(rows, extra=True)
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, d, sf_dir)
            assert out.columns == d.columns, name
            out.collect()
        P.STAGES[-1][1](spark, d, sf_dir).collect()


def found(index, texts):
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    return [(r[0], r[1]) for r in D.leaks(index, np.frombuffer(b"".join(raw), np.uint8), off)]


def test_windows_open_at_every_boundary():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    short = [(i, (" ".join(word() for _ in range(20)))[:42].strip() + "x") for i in range(20)]
    index = D.Index(short)
    for i, t in short:
        for texts in (["some text", t], [t[:3], "", t + " y"], [f'"{t}"', "x"], [f"so ({t}), yes"], [f"«{t}»"], [f"¿{t}?"], [f"“{t}”"]):
            assert [n for _, n in found(index, texts)] == [i], texts
    script = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(40))
    thai = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(40))
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(150))
    index = D.Index([(0, script), (1, thai), (2, letters)])
    assert found(index, ["見" * 9 + script + "見" * 9]) == [(0, 0)]
    assert found(index, ["กข" * 9 + thai + "กข" * 9]) == [(0, 1)]
    assert found(index, ["xyz" + letters + "xyz"]) == [(0, 2)]


def test_recall_by_length():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    for size, least in ((5, 1), (9, 1), (12, 1), (15, 1), (18, 1), (30, 1), (45, 1), (60, 1), (80, 1), (127, 1), (128, 0.95), (170, 0.95)):
        known = [(i, prose(60)[:size].replace(" ", "z", 1).strip().ljust(size, "q")) for i in range(20)]
        index = D.Index(known)
        hits = 0
        for i, t in known * 3:
            x = f"{prose(20)} {spoiled(rng, t, int(0.1 * size))} {prose(20)}"
            hits += (0, i) in found(index, [x])
        assert hits >= least * 60, (size, hits)
    assert found(D.Index([(1, "tiny")]), ["no", "a TINY", "mytiny|tiny"]) == [(1, 1), (2, 1), (2, 1)]
    assert found(D.Index([(1, "  "), (2, "")]), ["a  b", ""]) == []


def test_a_shared_phrase_is_thinned_out():
    """A phrase of a thousand items proposes them all, and few of them are searched."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    phrase = "which of the following statements about the given passage of text is the only one that is true " * 2
    long = [(i, phrase + prose(30)) for i in range(400)]
    short = [(1000 + i, phrase[:50] + prose(12)[:60]) for i in range(400)]
    index = D.Index(long + short)
    text = f"{prose(30)} {phrase} {prose(200)} {spoiled(rng, long[7][1], 9)} {prose(20)} {short[9][1]}"
    data, _ = D.normal(np.frombuffer(text.encode(), np.uint8))
    ends = np.array([0, len(data)])
    cells, places = index.proposals(data, ends), index.pieces.proposals(data, ends)
    assert len(set(cells[:, 0])) == 400 and len(set(places[:, 0])) == 400
    left = index.likely(data, cells[:, 0], cells[:, 2] * D.CELL, D.CELL).sum() + index.likely(data, places[:, 0], places[:, 2], 0).sum()
    assert left < 60, left
    assert {n for _, n in found(index, [text])} == {7, 1009}


def test_clean_judges_rows_not_ids(docs, spark):
    rng = random.Random(8)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    items = spark.createDataFrame([(1, item), (2, "another item of some twenty bytes"), (None, None)], "item_id long, text string")
    rows = [(1, "x " + item), (1, "clean"), (None, item + " y"), (None, "clean too"), (None, None), (2, ""), (3, "so another item of some twenty bytes.")]
    for block in (20_000, 1):
        out = D.clean(docs(rows, extra=True), items, block=block)
        assert out.columns == docs(rows, extra=True).columns
        assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == [("1", "clean"), ("2", ""), ("None", "None"), ("None", "clean too")]
    assert D.clean(docs([]), items).count() == 0 and D.clean(docs(rows), items.limit(0)).count() == len(rows)
