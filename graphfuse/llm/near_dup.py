"""MinHash near-duplicate detection with HyperMinHash sketches.

A document's distinct 5-word shingles are hashed to 64 bits.  The first bits
choose a bucket; the bucket keeps, of its smallest value, the number of leading
zeros and the bits after the first one (Yu & Weber, "HyperMinHash", 2017), 16
bits a register.  Four registers make a band, in which an empty bucket shows the
register of another one (Shrivastava, "Optimal densification", 2017): few
shingles leave most buckets empty, and bands of empty registers would agree by
chance, so often as the square of the number of short texts.  Documents that
agree on a band are candidates, whose Jaccard similarity is first estimated from the registers
(less the agreement that chance gives) and then confirmed on the full sets.

Shape of the job, none of it quadratic in a group of copies:

1. Texts with equal shingle sets become one class at once (one aggregation).
2. Bands are grouped; a band held by one class drops out.
3. Every class is held against the smallest class of each of its bands (a
   star).  Confirmed links give components; one component needs no more pairs.
4. Within a band, pairs of classes of different components remain.  Bands of
   few classes pair them outright, larger ones take one more leader, drawn by a
   hash of the band, and others after it as long as these link many classes: a
   family of near copies that its smallest one holds together badly is then one
   component, instead of many whose links would all be listed in step 5.
5. Classes of large bands that still hold several components are joined
   exactly: shingles are ordered from rare to common, and two sets can only
   reach the threshold if they share one of the first shingles of both (prefix
   and position filters, Chaudhuri et al. 2006, Xiao et al. 2008).  Pairs are
   ordered by size, for which the smaller set needs a shorter prefix.  A passage
   or template that very many texts share stands last in that order and pairs
   nobody.  Members of a shingle's leading component aren't paired with each other.
   Sets differ by no fewer shingles than parities of their shingles by remainder
   (a bitmap filter, Sandes et al. 2020, with parities), so that the join drops,
   without losing a link, nearly all pairs of a family of similarity 0.58 to 0.7,
   in which everyone shares prefixes and hardly anyone is linked.  It still looks
   at these pairs, one by one; the bound weakens above about 1,000 shingles.

Recall of the bands at a similarity of exactly 0.75: at least
1 - (1 - 0.75**4)**32 = 0.999995.  Estimates are cut at 0.5, six standard
errors below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf
from .cluster import Scratch, components, ship

U = np.uint64
EMPTY = 0xFFFF
#: Bits kept after the leading one.
MANTISSA = 10
BUCKETS = 128
BAND = 4
#: Bands of at most so many classes pair all of them; others go by leaders and prefixes.
SMALL = 8
#: Leaders are drawn again while a round links so large a share of the classes that it tries.
WORTH = 0.05
#: Where an empty bucket looks for a full one: all others, each bucket in an order of its own.
LENDERS = np.stack([np.append(b, np.random.default_rng(b).permutation(np.delete(np.arange(BUCKETS), b))) for b in range(BUCKETS)])
#: Below this estimate no pair can reach the threshold (six standard errors).
MARGIN = 0.25
#: Parities of a set's shingles, 64 a column: two sets differ by at least as many shingles as parities.
PARITIES = 1024
PARITY = [f"w{k}" for k in range(PARITIES // 64)]


def registers(h: np.ndarray, buckets: int) -> np.ndarray:
    """HyperMinHash registers of one sorted array of distinct hashes."""
    shift = U(64 - (buckets.bit_length() - 1))
    out = np.full(buckets, EMPTY, np.uint16)
    if not len(h):
        return out
    ids = np.arange(buckets, dtype=np.uint64)
    at = np.minimum(np.searchsorted(h, ids << shift), len(h) - 1)
    low = h[at]  # the smallest hash of a bucket is its first
    full = low >> shift == ids
    rest = (low << (U(64) - shift)) | U(1)
    zeros = U(63) - np.floor(np.log2(rest.astype(np.float64))).astype(np.uint64).clip(0, 63)
    after = (rest << zeros << U(1)) >> U(64 - MANTISSA)
    out[full] = ((zeros << U(MANTISSA)) | after).astype(np.uint16)[full]
    return out


def chance(n: np.ndarray | float, m: np.ndarray | float) -> np.ndarray | float:
    """Probability that two unrelated registers of sets of n and m agree.

    Registers whose bucket holds about n / buckets values agree by chance when
    leading zeros and mantissa do: one part in 2**MANTISSA, a third of that for
    the spread of the leading zeros.
    """
    return np.minimum(n, m) / np.maximum(np.maximum(n, m), 1) * 2.0**-MANTISSA / 3


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Band keys of register rows, none of them all empty.

    A register agrees with a probability of the similarity, lent ones too: the
    first full bucket of either set in a bucket's order lends to both or to one only.
    """
    lender = np.tile(np.arange(BUCKETS), (len(regs), 1))
    row, at = np.nonzero(regs == EMPTY)
    for step in range(1, BUCKETS):
        if not len(row):
            break
        other = LENDERS[at, step]
        full = regs[row, other] != EMPTY
        lender[row[full], at[full]] = other[full]
        row, at = row[~full], at[~full]
    shown = np.take_along_axis(regs, lender, axis=1).astype(np.uint64) | lender.astype(np.uint64) << U(16)
    with np.errstate(over="ignore"):
        key = np.tile(textbuf.mix(np.arange(1, BUCKETS // BAND + 1, dtype=np.uint64)), (len(regs), 1))
        for k in range(BAND):
            key = textbuf.mix(key + shown[:, k::BAND])
    return key


@textbuf.lean
def band_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, regs) to one row a band: (rep, band)."""
    for batch in it:
        if not batch.num_rows:
            continue
        key = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS))
        at = np.repeat(np.arange(batch.num_rows), key.shape[1])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(key.reshape(-1).view(np.int64))], names=["rep", "band"])


@textbuf.lean
def sketch_batches(it: Iterator[pa.RecordBatch], threshold_words: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, d1, d2, regs)."""
    for batch in it:
        ids = batch.column(0)
        for lo, hi, off, data in textbuf.runs(batch.column(1)):
            sets = list(shingle_sets(off, data, threshold_words))
            regs = [registers(u, BUCKETS).tobytes() for u in sets]
            with np.errstate(over="ignore"):
                d1 = np.array([u.sum() for u in sets], np.uint64).view(np.int64)
                d2 = np.array([textbuf.mix(u ^ U(0x5851F42D4C957F2D)).sum() for u in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array([len(u) for u in sets], pa.int64()), pa.array(d1), pa.array(d2), pa.array(regs, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "regs"],
            )


def shingle_sets(off: np.ndarray, data: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a run."""
    s, e, first = textbuf.words(off, data)
    h = textbuf.span_hash(textbuf.prefix(data, textbuf.BYTE_LOWER), s, e)
    sh, start = textbuf.shingles(h, first, k)
    for i in range(len(off) - 1):
        u = np.sort(sh[start[i] : start[i + 1]])
        yield u[np.concatenate(([True], u[1:] != u[:-1]))] if len(u) else u


@textbuf.lean
def set_batches(it: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, hashes): full sets of candidates."""
    for batch in it:
        ids = batch.column(0)
        for lo, hi, off, data in textbuf.runs(batch.column(1)):
            sets = [u.tobytes() for u in shingle_sets(off, data, k)]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["doc_id", "hashes"])


@textbuf.lean
def spread_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hashes) to one row a shingle: (doc_id, n, t)."""
    for batch in it:
        sets = batch.column(1).to_pylist()
        for lo in range(0, len(sets), 256):
            part = sets[lo : lo + 256]
            n = np.array([len(x) // 8 for x in part])
            at = np.repeat(np.arange(len(part)), n)
            flat = np.frombuffer(b"".join(part), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)).take(pa.array(at)), pa.array(n[at]), pa.array(flat)], names=["doc_id", "n", "t"])


@textbuf.lean
def parity_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, component, hashes) to (doc_id, component, n, w0, w1, ...): bit i is the parity of the shingles of remainder i."""
    for batch in it:
        sets = batch.column(2).to_pylist()
        for lo in range(0, len(sets), 256):
            part = sets[lo : lo + 256]
            n = np.array([len(x) // 8 for x in part])
            bit = (textbuf.mix(np.frombuffer(b"".join(part), np.uint64)) % U(PARITIES)).astype(np.int64)
            odd = np.bincount(np.repeat(np.arange(len(part)), n) * PARITIES + bit, minlength=len(part) * PARITIES) & 1
            words = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(part), -1)
            own = [batch.column(k).slice(lo, len(part)) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n), *(pa.array(np.ascontiguousarray(w)) for w in words.T)], names=["doc_id", "component", "n", *PARITY])


@textbuf.lean
def prefix_batches(it: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, [(df, t)]) to (t, doc_id, n, pos, short) for the prefix of each set.

    Shingles that no other set holds come first and are not listed.  Of two
    sets x, y that reach the threshold, |x| <= |y|, the common part has at least
    2p / (1 + p) of x and p of y (p the threshold), so the first common shingle
    stands in the first |y| - ceil(p |y|) + 1 of y and is ``short`` in x: among
    its first |x| - ceil(2p / (1 + p) |x|) + 1.
    """
    for batch in it:
        n = batch.column(1).to_numpy()
        for i, shared in enumerate(batch.column(2)):
            v = shared.values
            df, t = v.field("df").to_numpy(), v.field("t").to_numpy()
            order = np.lexsort((t, df))
            m = int(n[i])
            alone = m - len(t)
            take = max(0, m - -(-m * percent // 100) + 1 - alone)
            short = m - -(-2 * percent * m // (100 + percent)) + 1 - alone
            t = t[order[:take]]
            if len(t):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t), pa.repeat(batch.column(0)[i], len(t)), pa.array(np.full(len(t), m)), pa.array(alone + np.arange(len(t))), pa.array(np.arange(len(t)) < short)],
                    names=["t", "doc_id", "n", "pos", "short"],
                )


@textbuf.lean
def estimate_batches(it: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, ra, rb): keeps pairs whose estimated similarity is at least ``least``."""
    for batch in it:
        if not batch.num_rows:
            continue
        na, nb = (batch.column(i).to_numpy() for i in (2, 3))
        ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (4, 5))
        either = ((ra != EMPTY) | (rb != EMPTY)).sum(axis=1)
        agree = ((ra == rb) & (ra != EMPTY)).sum(axis=1)
        j = (agree - either * chance(na, nb)) / np.maximum(either, 1)
        # few registers say little: small sets all go to the exact step
        ok = ((j >= least) | (np.minimum(na, nb) < BUCKETS)) & (np.minimum(na, nb) >= (least + MARGIN) * np.maximum(na, nb) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))


@textbuf.lean
def verify_batches(it: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, ha, hb): keeps pairs with 100 * intersection >= percent * union of the full sets."""
    for batch in it:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.intersect1d(x, y, assume_unique=True).size
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest linked id), kept.

    Null and empty texts have no shingles and are linked with nothing; texts of
    fewer words than a shingle are one shingle.  A repeated row is returned as
    often as it stands.  Ids are of any type that has an order; rows of one id are
    one document, linked where one of them is, and a row without an id is linked
    to the smallest id that is known among its equals.  Columns other than the two
    named are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near-dup")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    sig = scratch.save(
        docs.mapInArrow(lambda it: sketch_batches(it, words), f"doc_id {kind}, n_shingles long, d1 long, d2 long, regs binary"), "sig"
    )
    classes = scratch.save(
        sig.filter("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("regs").alias("regs")), "classes"
    )
    regs = classes.select("rep", "n_shingles", "regs")

    # a set of n shingles is alike to another one by n / (n + 1) at most, so smaller ones are linked with equal sets only
    bands = regs.filter(F.col("n_shingles") * (100 - percent) >= percent).select("rep", "regs").mapInArrow(band_batches, f"rep {kind}, band long")
    coarse = scratch.save(_shared(bands, scratch), "coarse")
    rounds = _Rounds(scratch, regs, percent, kind)

    texts = docs.join(coarse.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text")
    rounds.sets = scratch.save(texts.mapInArrow(lambda it: set_batches(it, words), f"doc_id {kind}, hashes binary"), "sets")
    rounds.add(_star(coarse))
    small, large = coarse.filter(F.col("m") <= SMALL), coarse.filter(F.col("m") > SMALL)
    rounds.add(rounds.across(small).unionByName(rounds.across_star(large)))
    while rounds.open * WORTH <= rounds.found:
        rounds.add(rounds.across_star(large))
    rounds.add(rounds.across_prefixes(large))

    linked = rounds.labels
    member = classes.join(linked, classes.rep == linked.node, "left").select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = sig.join(member, ["n_shingles", "d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _shared(bands: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, rep, m, lead) for bands held by at least two classes.

    Grouped tables are written before they are joined, here and below: Spark
    can then split a hot key's rows over tasks.
    """
    size = scratch.save(bands.groupBy("band").agg(F.count("*").alias("m"), F.min("rep").alias("lead")).filter("m > 1"), "sizes")
    return bands.join(size, "band")


def _star(held: DataFrame) -> DataFrame:
    return held.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))


class _Rounds:
    """Pairs are tested in rounds; each leaves the components known so far."""

    def __init__(self, scratch: Scratch, regs: DataFrame, percent: int, kind: str):
        self.scratch, self.regs, self.percent, self.kind = scratch, regs, percent, kind
        self.sets: DataFrame
        self.edges: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.labels: DataFrame
        self.n = self.steps = self.found = 0
        self.open = 1

    def add(self, pairs: DataFrame) -> None:
        self.n += 1
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        r = self.regs
        pairs = (
            pairs.join(r.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra")), "a")
            .join(r.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb")), "b")
            .select("a", "b", "na", "nb", "ra", "rb")
        )
        least = self.percent / 100 - MARGIN
        likely = self.scratch.save(pairs.mapInArrow(lambda it: estimate_batches(it, least), f"a {self.kind}, b {self.kind}"), f"likely-{self.n}")
        self.tested = likely if self.tested is None else self.tested.unionByName(likely)
        s, percent = self.sets, self.percent
        full = (
            likely.join(s.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a")
            .join(s.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb")), "b")
            .select("a", "b", "ha", "hb")
        )
        new = self.scratch.save(full.mapInArrow(lambda it: verify_batches(it, percent), f"a {self.kind}, b {self.kind}"), f"links-{self.n}")
        self.found = new.count()
        self.edges = new if self.edges is None else self.edges.unionByName(new)
        self.labels = self.scratch.save(components(self.edges, self.scratch, f"cc-{self.n}"), f"labels-{self.n}")

    def _placed(self, held: DataFrame) -> DataFrame:
        """Members of bands that still hold more than one component."""
        x = held.join(self.labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        self.steps += 1
        x = self.scratch.save(x, f"held-{self.steps}")
        mixed = self.scratch.save(x.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("band"), f"mixed-{self.steps}")
        return x.join(mixed, "band", "left_semi")

    def across(self, held: DataFrame) -> DataFrame:
        """Pairs of a band that are of different components."""
        x = self._placed(held).select("band", "rep", "component")
        y = x.select("band", F.col("rep").alias("b"), F.col("component").alias("cb"))
        return x.join(y, "band").filter("rep < b and component <> cb").select(F.col("rep").alias("a"), "b")

    def across_star(self, held: DataFrame) -> DataFrame:
        """A band's classes against one more leader, which each band and round draws anew.

        ``open``: how many classes were held against a leader of another component.
        """
        x = self._placed(held)
        drawn = F.min(F.struct(F.xxhash64("band", "rep", F.lit(self.steps)).alias("h"), F.col("rep").alias("next"), F.col("component").alias("cn")))
        other = self.scratch.save(x.filter("rep is not null").groupBy("band").agg(drawn.alias("o")).select("band", "o.next", "o.cn"), f"others-{self.steps}")
        pairs = self.scratch.save(x.join(other, "band").filter("component <> cn").select(F.col("next").alias("a"), F.col("rep").alias("b")), f"led-{self.steps}")
        self.open = max(1, pairs.select("b").distinct().count())
        return pairs

    def across_prefixes(self, held: DataFrame) -> DataFrame:
        """Every pair of different components among the classes of mixed bands that can reach the threshold."""
        percent, t = self.percent, self.percent / 100
        who = self._placed(held).select(F.col("rep").alias("doc_id"), "component").distinct().join(self.sets, "doc_id").select("doc_id", "component", "hashes")
        who = self.scratch.save(who.mapInArrow(parity_batches, f"doc_id {self.kind}, component {self.kind}, n long, {', '.join(w + ' long' for w in PARITY)}"), "mixed")
        rows = self.scratch.save(self.sets.join(who.select("doc_id"), "doc_id", "left_semi").mapInArrow(spread_batches, f"doc_id {self.kind}, n long, t long"), "spread")
        common = self.scratch.save(rows.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1"), "common")
        by_set = rows.join(common, "t").groupBy("doc_id", "n").agg(F.collect_list(F.struct("df", "t")).alias("shared"))
        post = by_set.mapInArrow(lambda it: prefix_batches(it, percent), f"t long, doc_id {self.kind}, n long, pos long, short boolean").join(who, ["doc_id", "n"])
        post = self.scratch.save(post, "prefixes")
        sizes = post.groupBy("t", "component").agg(F.count("*").alias("k"))
        lead = sizes.groupBy("t").agg(F.max_by("component", F.struct("k", "component")).alias("lead"), F.count("*").alias("kinds")).filter("kinds > 1").select("t", "lead")
        lead = self.scratch.save(lead, "leads")
        mixed = post.join(lead, "t").withColumn("led", F.col("component") == F.col("lead"))
        # so many shingles must be common, and no more can be than stand from here on
        need = t / (1 + t) * (F.col("na") + F.col("nb")) - 1e-9
        can = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        near = (F.col("na") >= t * F.col("nb") - 1e-9) & (can >= need) & (F.col("ca") != F.col("cb"))
        apart = sum((F.bit_count(F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b"))) for w in PARITY), F.lit(0))
        return by_prefix(mixed).filter(near & (apart <= F.col("na") + F.col("nb") - 2 * need)).select("a", "b")


def by_prefix(post: DataFrame) -> DataFrame:
    """Pairs (a, na, pa, ca, parities, b, nb, pb, cb, parities) of sets that share a shingle of the smaller one's short prefix.

    post: (t, doc_id, n, pos, component, short, led, parities).  Sets of a shingle's leading
    component (``led``) meet the others only.  Of equal sizes the one of the smaller
    id counts as smaller.
    """
    side = lambda x: ["t", "led", *(F.col(c).alias(k + x) for c, k in (("doc_id", ""), ("n", "n"), ("pos", "p"), ("component", "c"))), *(F.col(w).alias(w + x) for w in PARITY)]
    small, large = post.filter("short").select(*side("a")), post.select(*side("b"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = lambda x, y: x.drop("led").join(y.drop("led"), "t").filter(ordered)
    return met(small.filter("not led"), large).unionByName(met(small.filter("led"), large.filter("not led")))
