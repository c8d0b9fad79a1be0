"""Token ids, packing and separator scans against the tokeniser itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphfuse.llm import packing, textbuf, token_count, tokens

ODD = ["a", "B", "é", "É", "ß", "'s", "'T", "9", "12", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", " ", "\n", "é", "Å", "—", "日本", "İ", "Σ", "\x1c", "\x85", "　", "×", "👍🏽", "½", "thon", "Thon,"]


@pytest.fixture(scope="module")
def words():
    return tokens.WordTokens.of(tokens.vocabulary())


def test_ids_are_the_tokenisers(words):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["", None, "word " * 5000]
    want = [e.ids for e in words.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for lo, hi, off, data in textbuf.runs(pa.array(texts, pa.large_string())):
        ids, start = words.encode(off, data, 2)
        for i in range(hi - lo):
            assert ids[start[i] : start[i + 1]].tolist() == [*want[lo + i], 2]


def check(df, words, tiers=packing.TIERS):
    want = [np.array([*words.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in df.collect()]
    rows = packing.pack(df, tiers, with_ids=True).collect()
    by_seq = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) and r.length == len(r.ids)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].tier <= tiers[-1] and at & (at - 1) == 0  # no padding
    made = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.doc_tokens, r.start)):
        made.setdefault((r.doc_id, r.doc_tokens), []).extend(r.ids)
    assert sorted(sum(map(list, want), [])) == sorted(i for r in rows for i in r.ids)
    return made, want


def test_pack(docs, words):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "Gamma", "thon"]) for _ in range(rng.choice([0, 1, 30, 700, 5000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long " * 20_000)]
    made, want = check(docs(rows, extra=True), words)
    assert {k[0]: np.array(v, "<u4").tobytes() for k, v in made.items()} == {r[0]: w.tobytes() for r, w in zip(rows, want, strict=True)}
    check(docs([(1, "x y"), (1, "x y"), (None, "z")]), words)
    assert packing.pack(docs([])).count() == 0


def test_packer_fills_and_balances():
    rng = random.Random(3)
    got = []
    p = packing.Packer((64, 128, 256), lambda tier, w: got.append((tier, w)))
    sizes = {k: rng.randrange(1, 700) for k in range(300)}
    for k, n in sizes.items():
        p.add(k, n)
        if k % 50 == 0:
            p.pack()
    p.finish()
    assert all(sum(x[0] for x in w) == tier for tier, w in got)
    for k, n in sizes.items():
        parts = sorted((s, m) for _, w in got for m, key, s in w if key == k)
        assert sum(m for _, m in parts) == n and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:]))
    steps = packing._Steps(1000, 256)
    load = {}
    for tier, _ in got:
        load[steps.deal(tier)] = load.get(g := steps.next - 1, 0)
    with pytest.raises(ValueError):
        packing.Packer((100, 200), print)


def flat(lengths, end=7):
    return np.concatenate([np.r_[np.full(n - 1, 1), end] for n in lengths]) if lengths else np.zeros(0)


@pytest.mark.parametrize("block,group", [(1, 2), (3, 7), (64, 1024), (10_000, 1024)])
def test_separator_scan(spark, tmp_path, monkeypatch, block, group):
    """Every document of files of many shapes, against a plain walk."""
    monkeypatch.setattr(token_count, "GROUP", group)
    rng = random.Random(block)
    files = {"a": [rng.randrange(1, 20) for _ in range(50)], "b": [500], "c": [1] * 40, "d": [64] * 3, "empty": []}
    want = []
    for f, lengths in files.items():
        ids = flat(lengths).astype("<u4")
        rest = 3 if f in "ae" else 0
        ids = np.r_[ids, [1] * rest].astype("<u4")
        (tmp_path / f).write_bytes(ids.tobytes() + (b"x" if f == "c" else b""))
        start = np.cumsum([0, *lengths])
        want += [(f, i, start[i], n, True) for i, n in enumerate(lengths)] + ([(f, len(lengths), start[-1], rest, False)] if rest else [])
    (tmp_path / "none").write_bytes(b"")
    listed = token_count.token_files(spark, str(tmp_path))
    got = sorted((r.file.rsplit("/", 1)[1], r.ordinal, r.start, r.n_tokens, r.closed) for r in token_count.scan_files(listed, 7, 4, block).collect())
    assert got == sorted(want)


def test_corpus_counts(docs, words, tmp_path):
    rows = [(i, "alpha beta, Grüße 42 \U0001F600 " * i) for i in range(30)] + [(99, None), (98, ""), (97, "a <|endoftext|> b <|ENDOFTEXT|>"), (96, "ÿÀ\xff\x00 \n"), (99, None), (None, "x")]
    df = docs(rows, extra=True).coalesce(3)
    want = sorted(len(words.tokenizer.encode((t or "").replace("<|endoftext|>", "< |endoftext|>"), add_special_tokens=False).ids) + 1 for _, t in rows)
    got = token_count.corpus_counts(df, block=16).collect()
    assert sorted(r.n_tokens for r in got) == want and all(r.closed for r in got)
    assert token_count.corpus_counts(docs([])).count() == 0
    # the files hold the ids and nothing else
    token_count.write_token_files(df, str(tmp_path / "flat"))
    ids = np.concatenate([np.fromfile(p, "<u2") for p in sorted((tmp_path / "flat").glob("part-*"))])
    texts = np.split(ids, np.flatnonzero(ids == token_count.END) + 1)[:-1]
    plain = [words.tokenizer.encode((t or "").replace("<|endoftext|>", "< |endoftext|>"), add_special_tokens=False).ids for _, t in rows]
    assert sorted(x[:-1].tolist() for x in texts) == sorted(plain)


def test_registered_counts(spark, sf_dir, words):
    from graphfuse.llm.queries import queries

    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted(len(e.ids) + 1 for e in words.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False))
    assert sorted(r.n_tokens for r in queries()["op9_separator_scan"](spark, sf_dir).collect()) == want
