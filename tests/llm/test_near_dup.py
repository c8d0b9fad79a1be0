"""Near duplicates against all-pairs brute force."""

import random
import re

import numpy as np
import pytest

from graphfuse.llm import near_dup
from graphfuse.llm.queries import OP6_SQL
from tests.oracle import duck, same


def shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * (len(sets[a] | sets[b])):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def check(df, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == brute(rows)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 120]))) for _ in range(8)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        t = " ".join(w)
        if rng.random() < 0.3:  # a passage that many share
            t = " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60))) + " " + passage
        rows.append((i * 7 % 997, t))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    rows = corpus(seed)
    check(docs(rows), rows)


def test_one_large_group_of_near_copies(docs):
    rng = random.Random(9)
    base = [f"x{i}" for i in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    check(docs(rows), rows)


def test_templates_pair_nobody(docs, monkeypatch):
    """Pages of one template, alike to 0.67, make no quadratic number of rows."""
    rng = random.Random(3)
    template = [f"t{i}" for i in range(104)]
    joined = []

    def counting(post, plain=near_dup.by_prefix):
        out = plain(post)
        joined.append((post.count(), out.count()))
        return out

    monkeypatch.setattr(near_dup, "by_prefix", counting)
    rows = [(i, " ".join(template + [f"o{rng.randrange(10**6)}" for _ in range(25)])) for i in range(300)]
    rows += [(1000 + i, " ".join([*template, *(f"p{k}" for k in range(20)), *(f"q{rng.randrange(10**6)}" for _ in range(3))])) for i in range(40)]
    check(docs(rows), rows)
    assert joined and all(pairs <= 4 * len(rows) for _, pairs in joined), joined


@pytest.mark.parametrize("edits", [(3,), (2, 3)])
def test_families_below_the_threshold_list_no_pairs(docs, monkeypatch, edits):
    """Copies of one text with own words in two or three places each: alike to 0.66 to 0.76, all with common prefixes."""
    rng = random.Random(12)
    rows = []
    for i in range(250):
        w = [f"x{k}" for k in range(150)]
        for at in rng.sample(range(150), rng.choice(edits)):
            w[at] = f"y{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    pairs = []

    def counting(self, new, plain=near_dup._Rounds.add):
        pairs.append(new.distinct().count())
        return plain(self, new)

    monkeypatch.setattr(near_dup._Rounds, "add", counting)
    check(docs(rows), rows)
    assert pairs[-1] <= 4 * len(rows), pairs  # of 31,125


def test_parities_bound_the_difference():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for common, own in ((0, 1), (100, 20), (140, 30), (900, 100), (5000, 2000)):
        both, x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (common, own, own + 3))
        sets = [np.unique(np.concatenate([both, z])) for z in (x, y)]
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "component", "hashes"])
        out = pa.Table.from_batches(near_dup.parity_batches(iter([batch])))
        assert out.column("n").to_pylist() == [len(s) for s in sets]
        apart = sum(bin((a ^ b) & (1 << 64) - 1).count("1") for a, b in (out.column(w).to_pylist() for w in near_dup.PARITY))
        assert apart <= len(np.setxor1d(*sets)) and (apart >= 0.85 * (2 * own + 3) or own > 50)


def test_other_ids(spark):
    rows = corpus(5, 40)
    named = [(f"id{i:04}", t) for i, t in rows]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(named, "doc_id string, text string")).collect()}
    assert got == brute(named)


def test_edges(docs):
    five = "a b c d e"
    rows = [(5, None), (4, ""), (3, " \n\t"), (9, "one two"), (2, "ONE  two"), (8, five), (7, "A B c D e"), (6, "a b c d e f g h"), (11, "é É"), (12, "é é"), (13, "z " * 30000)]
    check(docs(rows, extra=True), rows)
    assert near_dup.near_duplicates(docs([])).count() == 0
    one = near_dup.near_duplicates(docs([(1, five), (1, five), (None, five), (None, "q w e r t y")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in one)[-1][0] == "None" and len(one) == 4


def test_registers_and_estimate():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (6000, 1000, 1000))
    x, y = (near_dup.registers(np.unique(np.concatenate([common, z])), near_dup.BUCKETS) for z in (a, b))
    j = (x == y).mean() - near_dup.chance(7000, 7000)
    assert abs(j - 0.75) < 0.15
    far = near_dup.registers(np.unique(a), near_dup.BUCKETS) == near_dup.registers(np.unique(b), near_dup.BUCKETS)
    assert far.mean() < 0.05


def test_short_texts_make_no_candidates_by_chance(docs, monkeypatch):
    """Unrelated short texts have mostly empty registers, which agreed before."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 5, 6, 9, 20, 40])))) for i in range(3000)]
    rows += [(5000 + i, t + " end") for i, t in rows[:60] if len(t.split()) > 9]
    pairs = []

    def counting(self, new, plain=near_dup._Rounds.add):
        pairs.append(new.distinct().count())
        return plain(self, new)

    monkeypatch.setattr(near_dup._Rounds, "add", counting)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(rows)).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    assert sum(pairs) < 200, pairs


def test_bands_find_small_sets():
    """Sets of any size at the threshold share a band."""
    rng = np.random.default_rng(1)
    for common, own in ((3, 1), (6, 2), (18, 6), (60, 20), (240, 80), (3000, 1000)):
        for _ in range(60):
            both = rng.integers(0, 1 << 63, common, dtype=np.uint64) * np.uint64(2)
            more = rng.integers(0, 1 << 63, own, dtype=np.uint64) * np.uint64(2)
            keys = near_dup.band_keys(np.stack([near_dup.registers(np.sort(x), near_dup.BUCKETS) for x in (both, np.concatenate([both, more]))]))
            assert (keys[0] == keys[1]).any()


def test_sql_twin(spark, sf_dir):
    from graphfuse.llm.queries import queries

    same(queries()["op6_minhash_near_dedup"](spark, sf_dir), duck(sf_dir), OP6_SQL)


def test_components(spark):
    from graphfuse.llm.cluster import Scratch, components

    rng = random.Random(6)
    chain = list(range(120))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(50)] + [(7, 7), (chain[0], chain[1])]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()))
    assert got == {n: top(n) for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").count() == 0


def test_few_edges_are_joined_up_in_one_task(spark, monkeypatch):
    """The same components as by star steps, without their many shuffles."""
    from graphfuse.llm import cluster

    rng = random.Random(8)
    ends = [f"n{rng.randrange(400):03}" for _ in range(600)] + [f"p{i:03}" for i in range(300) for _ in (0, 1)][1:-1]
    edges = spark.createDataFrame(list(zip(ends[::2], ends[1::2])), "a string, b string")
    saved = []
    monkeypatch.setattr(cluster.Scratch, "save", lambda self, df, name, plain=cluster.Scratch.save: saved.append(name) or plain(self, df, name))
    one = sorted(map(tuple, cluster.components(edges, cluster.Scratch(spark, "t"), "c").collect()))
    assert len(saved) == 1, saved
    monkeypatch.setattr(cluster, "FEW", 0)
    assert one == sorted(map(tuple, cluster.components(edges, cluster.Scratch(spark, "t"), "d").collect()))
    assert len(saved) > 4
