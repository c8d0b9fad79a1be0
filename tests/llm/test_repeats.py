"""Repeated strings against a brute-force scan of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from graphfuse.llm import repeats


def brute(rows, size):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(x[k : k + size] for _, x in texts for k in range(len(x) - size + 1))
    out = []
    for i, x in texts:
        gone = np.zeros(len(x) + 1, int)
        for k in range(len(x) - size + 1):
            if seen[x[k : k + size]] > 1:
                gone[k] += 1
                gone[k + size] -= 1
        cut = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        out.append((i, len(x), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~cut].tobytes()).hexdigest()))
    return sorted(out, key=str)


def got(df, size):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, size).collect()), key=str)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(k) for k in (30, 45, 60, 90)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randrange(0, 60)) for _ in range(3)]
        for p in rng.sample(shared, rng.randrange(3)):
            lo = rng.randrange(0, max(1, len(p) // 2))
            parts.insert(rng.randrange(4), p[lo : rng.randrange(lo, len(p) + 1)])
        if rng.random() < 0.2:
            parts.append(parts[0] * 2)
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(docs, seed):
    rows = corpus(seed)
    assert got(docs(rows), 200) == brute(rows, 200)


def test_edges(docs):
    s = "abcdefghij" * 20
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (5, "z" * 201), (6, s), (7, "p" + s + "q"), (8, "é" * 150), (9, "é" * 150), (10, "k" * 3000), (11, "".join(chr(97 + i % 26) for i in range(100_000)))]
    assert got(docs(rows, extra=True), 200) == brute(rows, 200)
    assert got(docs([]), 200) == []
    twice = [(1, "".join(chr(33 + i * i % 90) for i in range(500)))] * 2
    assert {r[2] for r in got(docs(twice), 200)} == {500}


def test_text_and_columns_come_back(docs):
    s = "".join(chr(33 + (i * 7 + i * i) % 90) for i in range(260))
    df = docs([(1, s + " tail one"), (2, "head two " + s), (3, None)], extra=True)
    rows = {r.doc_id: r for r in repeats.remove_repeats(df, 200, with_text=True).collect()}
    assert rows[1].kept_text == " tail one" and rows[2].kept_text == "head two " and rows[3].kept_text is None
    assert [(x.start, x.stop) for x in rows[2].removed] == [(9, 269)]
    assert rows[1].own.source == "s" and rows[1].own.lows == "clash"


def test_anchors_are_chosen_by_content():
    rng = np.random.default_rng(1)
    x = rng.integers(97, 110, 5000).astype(np.uint8)
    doc, pos, name, _ = repeats.anchors(np.array([0, 5000]), x, 200)
    gaps = np.diff(pos)
    assert gaps.max() <= 101 and len(pos) < 5000 / 25  # every window holds one, and few are needed


@pytest.mark.parametrize("seed", [4, 5])
def test_ids_that_repeat_or_are_null(docs, spark, seed):
    """Spans belong to a row, whatever its id."""
    rng = random.Random(seed)
    rows = corpus(seed)
    mixed = [(rng.choice([None, 1, 2, i]), t) for i, t in rows] + [(1, "short"), (1, None), (None, None), (2, "")]
    mixed += [mixed[0], mixed[0]]
    assert got(docs(mixed, extra=True), 200) == brute(mixed, 200)
    named = spark.createDataFrame([(None if i is None else f"id {i}", t) for i, t in mixed], "doc_id string, text string")
    assert [r[1:] for r in got(named, 200)] == [r[1:] for r in sorted(((None if i is None else f"id {i}", *x) for i, *x in brute(mixed, 200)), key=str)]


def test_the_pipeline_stage_keeps_rows_of_one_id_apart(docs, spark, sf_dir):
    import corpus_pipeline as P

    s = "".join(chr(33 + (i * 7 + i * i) % 90) for i in range(260))
    rows = [(1, "one " + s), (1, "two"), (None, s + " three"), (None, None)]
    out = P.repeated_strings(spark, docs(rows, extra=True), sf_dir).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in out) == [("1", "one "), ("1", "two"), ("None", ""), ("None", " three")]
