"""Quality, toxicity and language models: held-out accuracy, edges; counting rules by brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphfuse.llm import fit, language, quality_classifier, quality_rules, toxicity

BIG = "/root/testdata/sf0.01"


def base(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", t)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


EDGES = [(1, None), (2, ""), (3, " \n\n "), (4, "a b c a b c"), (5, "x\nx\n\nx \nx"), (6, "é ü 日本 #*|"), (7, "w " * 40_000), (8, "one\r\ntwo\r\none"), (9, "q"), (10, "a b c"), (11, "a b a b a b")]


def test_counting_rules(docs):
    rng = random.Random(1)
    rows = EDGES + [(100 + i, " ".join(rng.choice(["a", "b", "c\n", "d|", "\n"]) for _ in range(rng.randrange(80)))) for i in range(60)]
    for r in quality_rules.quality_rules(docs(rows, extra=True)).collect():
        want = base(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(docs([])).count() == 0
    assert quality_rules.quality_rules(docs([(1, "a b", None), (1, "a b", None)])).count() == 2


def brute_model(texts, evidence=quality_rules.EVIDENCE):
    """P(word | word before) of the language model by dictionaries; None stands for the edge, "?" for unknown words."""
    seqs = [[w.lower() for w in re.findall("[^\x20\x09-\x0D]+", t or "")] for t in texts]
    n = Counter(w for s in seqs for w in s)
    vocab = {w for w in n if n[w] >= 2}
    kinds = len(n) - len(vocab)
    seqs = [[None, None, *(w if w in vocab else "?" for w in s), None] for s in seqs if s]
    three = {tuple(s[i - 2 : i + 1]) for s in seqs for i in range(2, len(s))}
    cont = Counter(w for v, w in {(v, w) for _, v, w in three})
    size = len(vocab) + 2
    d1 = quality_rules.discounts(*(sum(c == r for c in cont.values()) for r in (1, 2, 3, 4)))
    total = sum(cont.values())
    alone = {w: (cont[w] - d1[min(cont[w], 3)]) / total for w in [*vocab, "?", None]}
    rest = 1 - sum(alone.values())
    alone = {w: p + rest / size for w, p in alone.items()}
    pairs = Counter((v, w) for _, v, w in three if v != "?")
    d2 = quality_rules.discounts(*(sum(c == r for c in pairs.values()) for r in (1, 2, 3, 4)))
    context = Counter()
    for (v, _), c in pairs.items():
        context[v] += c
    own = {(v, w): (c - d2[min(c, 3)]) / context[v] for (v, w), c in pairs.items() if c >= evidence and w != "?"}
    left = Counter()
    for (v, _), p in own.items():
        left[v] += p

    def log_p(v, w):
        w = w if w is None or w in vocab else "?"
        v = v if v is None or v in vocab else "?"
        return math.log((1 - left[v]) * alone[w] + own.get((v, w), 0)) - (math.log(max(1, kinds)) if w == "?" else 0)

    return log_p, [*vocab, "?", None]


def model_texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["The", "the", "of", "é#", "a"]
    return [" ".join(rng.choice(words[: rng.choice((6, 20, 45))]) + ("x%d" % rng.randrange(400) if rng.random() < 0.1 else "") for _ in range(rng.randrange(40))) for _ in range(n)] + ["", None, "one"]


@pytest.mark.parametrize("held", [quality_rules.HELD, 64])
def test_model_is_the_one_of_a_plain_count(docs, monkeypatch, held):
    texts = model_texts(2)
    monkeypatch.setattr(quality_rules, "HELD", held)
    monkeypatch.setattr(quality_rules, "SHARD", 100)
    m = quality_rules.train(docs(list(enumerate(texts))).repartition(5))
    assert (np.diff(m.vocabulary.hashes.astype(object)) > 0).all() and (np.diff(m.pairs.astype(object)) > 0).all() and len(m.pairs)
    log_p, _ = brute_model(texts)
    for t in texts:
        if not t:
            continue
        data = np.frombuffer(t.encode(), np.uint8)
        word, before, _ = m.vocabulary.sequence(np.array([0, len(data)]), data)
        w = t.lower().split()
        assert np.allclose(m.log_probs(word, before), [log_p(a, b) for a, b in zip([None, *w], w)], atol=1e-9)
    # the probabilities of all words behind any word sum up to one
    n = m.vocabulary.size
    for before in range(n):
        p = np.exp(m.log_probs(np.arange(n), np.full(n, before)))
        p[n - 2] *= max(1, m.vocabulary.unknown_kinds)
        assert abs(p.sum() - 1) < 1e-9


def test_blocks_of_keys():
    rng = np.random.default_rng(1)
    for top in (1, 2**8, 2**33, 2**64 - 1):
        keys = np.unique(rng.integers(0, top, 500, dtype=np.uint64, endpoint=True))
        step = np.diff(keys, prepend=np.uint64(0))
        assert (np.cumsum(quality_rules.unpack(quality_rules.pack(step), len(keys)), dtype=np.uint64) == keys).all()
    out = [b for x in (keys, keys[:9]) for b in quality_rules.Blocks(7, 4, 3, True).add(x)]
    assert out == []


def test_model_words():
    words = lambda t: quality_rules.tokens(np.array([0, len(t.encode())]), np.frombuffer(t.encode(), np.uint8))
    h, first = words("Ab 日本x ab 日\U00020000")
    assert first.tolist() == [0, 7] and h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 5


def test_rare_words_are_in_the_model_of_a_large_corpus(docs):
    """Scores are those of the plain count, whatever share of the corpus a word or a pair has; chunks are scored apart."""
    rng = random.Random(7)
    filler = [" ".join(rng.choice(("the", "of", "and", "to")) for _ in range(60_000)) for _ in range(6)]
    texts = filler + [f"{w} rare pair of{k % 3}" for k, w in enumerate("abcdefg")] + model_texts(5, 30)
    log_p, _ = brute_model(texts)
    frame = docs([(i, t) for i, t in enumerate(texts)])
    rows = quality_rules.quality_rules(frame.repartition(4)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = (texts[r.doc_id] or "").lower().split()
        if w:
            assert abs(r.log_perplexity + np.mean([log_p(a, b) for a, b in zip([None, *w], w)])) < 1e-9, texts[r.doc_id][:80]


def test_chunks_are_those_of_the_texts(monkeypatch):
    """However rows come in batches, chunks have the same names and documents."""
    monkeypatch.setattr(quality_rules, "CHUNK", 50)
    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "é" * rng.randrange(60) for _ in range(200)]
    found = []
    for step in (1, 7, 200):
        batches = (pa.RecordBatch.from_arrays([pa.array(texts[k : k + step], pa.string())], names=["text"]) for k in range(0, 200, step))
        found.append([(name, [t for b in held for t in b.column(0).to_pylist()]) for name, held in quality_rules.chunks(batches)])
    assert found[0] == found[1] == found[2] and len(found[0]) > 50
    assert [t for _, held in found[0] for t in held] == texts


def test_copies_teach_a_pair_once(docs):
    texts = model_texts(3)
    m = quality_rules.train(docs(list(enumerate(texts))))
    copied = quality_rules.train(docs(list(enumerate(texts + texts[:1] * 300))))
    data = np.frombuffer(texts[0].encode(), np.uint8)
    run = np.array([0, len(data)]), data
    assert abs(m.log_probs(*m.vocabulary.sequence(*run)[:2]).mean() - copied.log_probs(*copied.vocabulary.sequence(*run)[:2]).mean()) < 0.3


def test_bands_tell_languages_apart(docs):
    """Null has a band apart from the language of that name, and unspaced scripts are read by character."""
    rng = random.Random(4)
    common = [chr(0x4E00 + k) for k in range(60)]
    prose = lambda: " ".join("".join(rng.choice(common) for _ in range(6)) for _ in range(60))
    noise = " ".join("".join(chr(rng.randrange(0x5000, 0x9000)) for _ in range(6)) for _ in range(60))
    kana = " ".join("".join(chr(rng.randrange(0x3041, 0x3096)) for _ in range(6)) for _ in range(60))
    rows = [(i, prose(), "zh") for i in range(80)] + [(900, noise, "zh"), (901, kana, "zh"), (902, noise, None), (903, prose(), "und"), (904, kana, "und")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(rows)).collect()}
    assert not got[900].kept and not got[901].kept and got[902].kept
    assert sum(got[i].kept for i in range(80)) >= 78
    assert got[902].low != got[903].low


def test_the_band_decides(big):
    """Most of the bad documents that pass the counting rules fall to the band, hardly any good one."""
    documents, labels = big
    rows = quality_rules.quality_rules(documents).join(labels, "doc_id").filter("not base_failed").collect()
    share = {q: np.mean([not r.kept for r in rows if r.quality == q]) for q in (0, 1)}
    assert share[0] > 0.4 and share[1] < 0.02, share
    assert all(r.kept == (r.low <= r.log_perplexity <= r.high) for r in rows)


def test_perplexity_rejects_the_odd_one_out(docs):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice("the man saw a dog in that old house by river".split()) + rng.choice(["", "s", "ly"]) for _ in range(90))
    odd = "".join(rng.choice("xqzjkvw!?#7") + rng.choice(" qzx") for _ in range(500))
    rows = [(i, prose()) for i in range(200)] + [(999, odd + " w" * 60)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(rows)).collect()}
    assert not got[999].kept
    assert sum(r.kept for r in got.values()) >= 195


@pytest.fixture(scope="module")
def big(spark):
    read = lambda t: spark.read.parquet(f"{BIG}/{t}.parquet")
    return read("documents"), read("labels")


def auc(pos, neg):
    pos, neg = np.array(pos), np.array(neg)
    return (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()


def test_quality_held_out(big):
    documents, labels = big
    rows = quality_classifier.classify(documents, labels).join(labels, "doc_id").filter("held_out").collect()
    assert auc([r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity_held_out(big):
    documents, labels = big
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").filter("held_out").collect()
    assert auc([r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]) > 0.8
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_language_held_out(big):
    documents, _ = big
    rows = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_labels_of_held_out_rows_do_not_matter(big):
    documents, labels = big
    flipped = labels.withColumn("quality", F.when(fit.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    few = documents.filter("doc_id < 200")
    score = lambda lab: {r.doc_id: r.score for r in quality_classifier.classify(few, lab).collect()}
    assert score(labels) == score(flipped)


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(300).select(F.col("id").alias("doc_id"), fit.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_model_edges(docs, spark):
    rows = EDGES + [(20, "stupid idiot"), (21, "ok"), (22, "!!!"), (23, "123 456"), (24, "\U0001F44D\U0001F600")]
    df = docs(rows, extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(20, None, None), (21, 1, 0), (None, 0, 1), (1, 0, 1), (1, 0, 1)], none.schema)
    for labels in (none, odd):
        for f in (quality_classifier.classify, toxicity.toxicity):
            got = f(df, labels).collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
            assert f(docs([]), labels).count() == 0
    lang = {r.doc_id: r for r in language.identify(df).collect()}
    assert {lang[k].lang_pred for k in (1, 2, 3, 22, 23, 24)} == {"und"} and lang[9].lang_pred == "en"
    assert language.identify(docs([])).count() == 0
    assert language.identify(docs([(1, "abc", None), (2, "def", None)])).count() == 2


def test_bounded_sample(spark):
    df = spark.range(10_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    n = dict(map(tuple, fit.bounded(df, "label", 500).groupBy("label").count().collect()))
    assert all(400 < n[k] < 600 for k in (0, 1))


def test_bradley_terry_orders():
    rng = np.random.default_rng(0)
    raw = rng.random((400, 17)).astype(np.float32)
    label = (raw[:, 0] < 0.7).astype(int)
    m = quality_classifier.bradley_terry(raw, label)
    s = m.score(raw)
    assert auc(s[label == 1], s[label == 0]) > 0.97
    assert abs((s < quality_classifier.CUT).mean() - (label == 0).mean()) < 0.02


O, I, H, V, T, N, R = (getattr(toxicity, x) for x in ("OTHER", "INSULT", "THREAT", "INTENT", "TARGET", "NEGATION", "REPORT"))


def plain_score(symbols, weights):
    """The grammar in words: what stands before and behind each insult or threat."""
    total = 0.0
    for i, (s, w) in enumerate(zip(symbols, weights)):
        if s not in (I, H):
            continue
        before, near, after = symbols[:i], symbols[max(0, i - toxicity.REACH) : i], symbols[i + 1 :]
        f = 1.0 if s == I or V in near else 0.4
        f *= 1.5 if T in before else 1
        f *= 0.3 if N in near else 1
        f *= 0.5 if R in before else 1
        f *= 1.5 if T in after[: toxicity.REACH] else 1.25 if T in after else 1
        total += f * w
    return total


def test_grammar():
    s = lambda *x: toxicity.clause_score(list(x), [2.0 if k in (I, H) else 0.0 for k in x])
    plain = s(O, I)
    assert s(O, O) == 0 and plain == 2.0
    assert s(T, O, I) > plain and s(I, O, T) > plain
    assert s(N, I) < plain and s(N, O, O, I) < plain and s(N, O, O, O, I) == plain
    assert s(R, O, O, O, I) == plain / 2
    assert s(I, I) == 2 * plain and s(H) < s(V, H) < s(V, H, T)
    rng = random.Random(7)
    clauses = [[rng.choice((O, O, O, I, H, V, T, N, R)) for _ in range(rng.randrange(1, 30))] for _ in range(300)]
    weights = [[rng.random() if k in (I, H) else 0.0 for k in c] for c in clauses]
    want = [plain_score(c, w) for c, w in zip(clauses, weights)]
    assert np.allclose([toxicity.clause_score(c, w) for c, w in zip(clauses, weights)], want)
    at = [(k, j) for k, c in enumerate(clauses) for j, x in enumerate(c) if x != O]
    ids, got = toxicity.clause_scores(np.array([k for k, _ in at]), np.array([1000 * k + j for k, j in at]), np.array([clauses[k][j] for k, j in at]), np.array([weights[k][j] for k, j in at]))
    assert np.allclose(got, [want[k] for k in ids])


def test_long_clauses_take_linear_time():
    import time

    lex = toxicity.Lexicon({"idiot": 3.0})
    took = []
    for n in (20_000, 200_000):
        data = np.frombuffer(b"you idiot or " * n, np.uint8)
        began = time.perf_counter()
        doc, score = lex.clauses(np.array([0, len(data)]), data)
        took.append(time.perf_counter() - began)
        assert doc.tolist() == [0] and score[0] == pytest.approx(3.0 * 1.5 * (1.5 * (n - 1) + 1))
    assert took[1] < 30 * took[0] + 1


def test_words_make_clauses():
    lex = toxicity.Lexicon({"idiot": 3.0})
    off = np.array([0, 30, 30, 41, 80])
    text = b"He is NOT an IDIOT!! you idiot" + b"pidiot idio" + b"I will kill you. They kill time; ok" + b" it."
    doc, score = lex.clauses(off, np.frombuffer(text, np.uint8))
    assert doc.tolist() == [0, 0, 3, 3] and score[0] < score[1] and score[2] > 3 * score[3]
    own = toxicity.Lexicon({}, {**toxicity.WORDS, toxicity.THREAT: "smash"})
    assert own.clauses(np.array([0, 13]), np.frombuffer(b"smash or kill", np.uint8))[1].tolist() == [0.4]


def test_scoring_cuts_words_as_training_does():
    import pyarrow as pa

    from graphfuse.llm import textbuf

    lex = toxicity.Lexicon({"idiot": 3.0, "stupid": 3.0, "дурак": 3.0})

    def features(*texts):
        return [toxicity.document_features(lex, off, data)[:, 1:].tolist() for _, _, off, data in textbuf.runs(toxicity.prepared(pa.array(texts)))][0]

    plain = features("idiot")[0]
    assert plain[1] == 3.0
    spelt = ["¡idiota!", "«idiot»", "“idiot”", "‘idiot’", "x/idiot", "**********idiot", "l'idiot", "l’idiot", "IDIOT", "ДУРАК", "1idiot", "日idiot"[1:], "…idiot…"]
    assert all(f == plain for f in features(*spelt)), dict(zip(spelt, features(*spelt)))
    assert features("stupid/idiot") == features("stupid idiot") and features("stupid/idiot")[0][1] == 6.0
    assert features("you,idiot") == features("you, idiot") and features("you/idiot") == features("you idiot") and features("you/idiot")[0] != plain
    assert features("don’t idiot") == features("don't idiot") == features("not/idiot") != [plain]
    assert features("id", "iot", "pidiot", None, "") == [[0, 0, 0]] * 5
    text = "Ünï ²x3y d'où “né” _a_b 日本語 ½ привет\U00010400z o'"
    low = toxicity.prepared(pa.array([text]))
    _, _, off, data = next(textbuf.runs(low))
    s, e = toxicity.spans(toxicity.letters(data), off)
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == toxicity._WORD.findall(low[0].as_py())


def shares(spark, docs):
    """1,500 labelled documents, one in ten toxic and bad, most of them but not all to be told by a word."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 10 == 0
        words = [rng.choice("the man saw a dog in that old house by river".split()) for _ in range(60)]
        if rng.random() < (0.7 if toxic else 0.005):
            words.insert(30, "idiot")
        if rng.random() < (0.7 if toxic else 0.1):
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not toxic), int(toxic)))
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_does_not_depend_on_the_size_of_the_sample(docs, spark):
    df, labels = shares(spark, docs)
    mean = [toxicity.toxicity(df, labels, n).agg(F.avg(F.log(F.col("score") / (1 - F.col("score"))))).first()[0] for n in (4000, 100)]
    assert abs(mean[0] - mean[1]) < 0.7


def test_quality_threshold_covers_all_labelled_rows(docs, spark):
    df, labels = shares(spark, docs)
    for n in (20_000, 100):
        got = quality_classifier.classify(df, labels, n).filter("not held_out")
        assert abs(got.agg(F.avg(1 - F.col("predicted"))).first()[0] - 0.1) < 0.03
    values = np.random.default_rng(1).normal(size=700)
    m = spark.createDataFrame([(int(i >= 91), float(v)) for i, v in enumerate(values)], "label int, margin double")
    assert math.isclose(quality_classifier.threshold(m), np.quantile(values, 91 / 700))
