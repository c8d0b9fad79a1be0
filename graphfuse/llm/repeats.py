"""Removal of repeated byte strings by distributed prefix doubling.

Prefix doubling names the string of length 2h at a position by the pair of the
names of length h at the position and at h further on; positions whose name is
unique drop out, and the doubling ends once the length has passed the
threshold (Karp, Miller & Rosenberg 1972; Manber & Myers 1990).  Two changes
make it fit a corpus:

* A name is a fingerprint of the string, so equal strings are named alike
  without a global rank table, and the partner at offset h is read from the
  same text instead of being joined.
* The first round ranks only *anchors*: positions whose string of half the
  threshold is the smallest name of some window of threshold length.  Which
  positions are anchors depends on content alone and every window holds one, so
  two equal windows hold equally named anchors.  About one byte in fifty is an
  anchor, and nearly all of those drop out in that round.

Rounds (threshold t, half h = t / 2), each one grouping of (position, name
pair) rows by Spark:

1. Anchors by the name of length h.  Unique ones drop out.
2. Anchors by the pair (name of length h, name of all bytes that a window over
   the anchor can hold).  Where the pair repeats, each of those windows repeats.
3. Where it doesn't, the windows over an anchor are split into cells of
   neighbouring starts.  All windows of a cell share t - CELL bytes; cells are
   ranked by the name of these, and unique ones drop out.
4. The windows of the cells that are left, by the pair (name at i, name at
   i + h), which is the name of length t.

One member of each repeated pair of round 2 takes part in rounds 3 and 4, for
all of its copies.

A group of copies therefore costs one row a copy and round 2, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .cluster import Scratch, ship

U = np.uint64
RUN = 1 << 18
#: Starts of a cell.
CELL = 16


def slide(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of a[i : i + width] for every i that has one."""
    f = np.minimum if least else np.maximum
    have, out = 1, a
    while have * 2 <= width:
        out = f(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = f(out[: len(a) - width + 1], out[width - have : width - have + len(a) - width + 1])
    return out


def anchors(off: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position in it, name, name of its surroundings) of each anchor of a run."""
    n, half = len(data), size // 2
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    c = textbuf.prefix(data, sure=False)
    at = np.arange(n - half + 1)
    name = textbuf.span_hash(c, at, at + half)
    low = slide(name, size - half + 1, True)  # of the window that begins at i
    ends = off[1:]
    inside = np.ones(len(low), bool)
    for b in ends[:-1]:  # windows over the end of a document don't count
        inside[max(0, b - size + 1) : min(b, len(low))] = False
    low[~inside] = 0
    width = size - half + 1
    padded = np.zeros(len(name) + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(low)] = low
    p = np.flatnonzero(slide(padded, width, False) == name)
    doc = np.searchsorted(ends, p, "right")
    lo = np.maximum(off[doc], p - (size - half))
    hi = np.minimum(ends[doc], p + size)
    with np.errstate(over="ignore"):
        around = textbuf.mix(textbuf.span_hash(c, lo, hi) + (p - lo).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
    return doc, p - off[doc], name[p], around


@textbuf.lean
def anchor_batches(it: Iterator[pa.RecordBatch], size: int, full: bool) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) to one row an anchor: its name, and if ``full`` its surroundings and place."""
    for batch in it:
        for lo, hi, off, data in textbuf.runs(batch.column(2), RUN):
            doc, pos, name, around = anchors(off, data, size)
            cols = [pa.array(name.view(np.int64))]
            if full:
                own = pa.array(doc)
                cols += [pa.array(around.view(np.int64)), *(batch.column(k).slice(lo, hi - lo).take(own) for k in (0, 1)), pa.array(pos)]
            yield pa.RecordBatch.from_arrays(cols, names=["name", "around", "k1", "k2", "pos"][: len(cols)])


def cell_starts(n: int, pos: np.ndarray, size: int) -> np.ndarray:
    """First starts of the cells of the windows over anchors at ``pos`` in n bytes.

    Cells are laid from the anchor back, so that equal surroundings of two
    anchors have equal cells; a cell may hang over the end of its text.
    """
    reach = size - size // 2
    first = (pos[:, None] - np.arange(CELL - 1, reach + CELL, CELL)[None]).reshape(-1)
    return np.unique(first[(first > -CELL) & (first + size <= n)])


def _same(batch: pa.RecordBatch, i: int, n: int) -> list[pa.Array]:
    return [pa.repeat(batch.column(k)[i], n) for k in (0, 1)]


@textbuf.lean
def cell_batches(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, pos list) to (k1, k2, cell, name): cells by the bytes that its windows share."""
    for batch in it:
        off, data = textbuf.utf8(batch.column(2))
        where = batch.column(3)
        for i in range(batch.num_rows):
            text = data[off[i] : off[i + 1]]
            cell = cell_starts(len(text), where[i].values.to_numpy(), size)
            if not len(cell):
                continue
            lo = np.maximum(cell + CELL - 1, 0)
            hi = np.minimum(cell + size, len(text))
            name = textbuf.span_hash(textbuf.prefix(text, sure=False), lo, hi)
            yield pa.RecordBatch.from_arrays(
                [*_same(batch, i, len(cell)), pa.array(cell), pa.array(name.view(np.int64))], names=["k1", "k2", "cell", "name"]
            )


@textbuf.lean
def window_batches(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, cell list) to (k1, k2, start, n1, n2) for the windows of those cells."""
    half = size // 2
    for batch in it:
        off, data = textbuf.utf8(batch.column(2))
        where = batch.column(3)
        for i in range(batch.num_rows):
            text = data[off[i] : off[i + 1]]
            start = np.unique(where[i].values.to_numpy()[:, None] + np.arange(CELL)[None])
            start = start[(start >= 0) & (start + size <= len(text))]
            c = textbuf.prefix(text, sure=False)
            n1, n2 = textbuf.span_hash(c, start, start + half), textbuf.span_hash(c, start + half, start + size)
            for k in range(0, len(start), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [*_same(batch, i, len(start[part])), pa.array(start[part]), pa.array(n1[part].view(np.int64)), pa.array(n2[part].view(np.int64))],
                    names=["k1", "k2", "start", "n1", "n2"],
                )


def strip(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes stay, and (start, end) of the maximal removed runs."""
    mark = np.zeros(len(text) + 1, np.int32)
    np.add.at(mark, lo, 1)
    np.add.at(mark, hi, -1)
    gone = np.cumsum(mark[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    return ~gone, edge.reshape(-1, 2)


@textbuf.lean
def strip_batches(it: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, lo list, hi list) to the digest, or to the remaining text and the removed runs."""
    for batch in it:
        off, data = textbuf.utf8(batch.column(1))
        lows, highs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        known = batch.column(1).is_valid().to_pylist()
        n_bytes, n_removed, n_spans, digest, left, runs = [], [], [], [], [], []
        for i in range(batch.num_rows):
            text = data[off[i] : off[i + 1]]
            if lows[i]:
                keep, gone = strip(text, np.array(lows[i]), np.array(highs[i]))
                rest = text[keep].tobytes()
            else:
                gone, rest = np.zeros((0, 2), np.int64), text.tobytes()
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(rest))
            n_spans.append(len(gone))
            digest.append(hashlib.sha256(rest).hexdigest())
            if with_text:
                # a repeat may begin or end within a character: its loose bytes go too
                left.append(rest.decode("utf-8", "ignore") if known[i] else None)
                runs.append([{"start": int(a), "stop": int(b)} for a, b in gone])
        cols = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            cols += [pa.array(left, pa.string()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), batch.column(4)]
            names += ["kept_text", "removed", "own"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def with_keys(docs: DataFrame) -> DataFrame:
    """The rows with a key (k1, k2) that rows share only if they are of one id and one text.

    Where every id is known and has one text the id itself does, with a constant
    beside it that costs nothing to shuffle; else both parts are 64-bit hashes, of the
    id and of the text.
    """
    text = F.xxhash64("text")
    by_id = docs.select("doc_id", text.alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("z"))
    if by_id.filter("doc_id is null or a <> z").isEmpty():
        return docs.withColumns({"k1": F.col("doc_id"), "k2": F.lit(0).cast("long")})
    return docs.withColumns({"k1": F.xxhash64("doc_id"), "k2": text})


def remove_repeats(docs: DataFrame, size: int = 200, with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a ``size``-byte string that also starts elsewhere.

    docs: doc_id and text; null text is empty.  Strings never cross documents
    and are judged on the input.  Returns doc_id, n_bytes, n_removed, n_spans,
    kept_sha256; with_text adds kept_text (null stays null), removed (runs of
    byte offsets) and own, a struct of all columns of docs but text.  One row a row
    of docs, whose ids may be null or stand before several texts; a repeated row
    counts as a second text.  Texts shorter than ``size`` stay as they are.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "repeats")
    half = size // 2
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("own")] if with_text else []
    rows = with_keys(docs.select("doc_id", "text", *own))
    key = ["k1", "k2"]
    base = rows.select(*key, "text")
    of_key = f"k1 {base.schema['k1'].dataType.simpleString()}, k2 long"
    names = base.mapInArrow(lambda it: anchor_batches(it, size, False), "name long")
    twice = scratch.save(names.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name"), "names")
    found = base.mapInArrow(lambda it: anchor_batches(it, size, True), f"name long, around long, {of_key}, pos long")
    left = scratch.save(found.join(twice, "name", "left_semi"), "anchors")

    pairs = scratch.save(
        left.groupBy("name", "around").agg(F.count("*").alias("n"), F.min(F.struct(*key, "pos")).alias("one")), "pairs"
    )
    whole = left.join(pairs.filter("n > 1").select("name", "around"), ["name", "around"], "left_semi").select(
        *key, F.greatest(F.col("pos") - (size - half), F.lit(0)).alias("lo"), (F.col("pos") + size).alias("hi")
    )
    # grouped tables are written before they are joined, so that Spark can split a hot name's rows
    loose = pairs.groupBy("name").agg(F.min("n").alias("least"), F.count("*").alias("pairs")).filter("least = 1 and pairs > 1")
    loose = scratch.save(loose.select("name"), "loose")
    seeds = pairs.join(loose, "name", "left_semi").groupBy("one.k1", "one.k2").agg(F.collect_list("one.pos").alias("at"))
    texts = base.join(seeds, key).select(*key, "text", "at")
    cells = scratch.save(texts.mapInArrow(lambda it: cell_batches(it, size), f"{of_key}, cell long, name long"), "cells")
    again = scratch.save(cells.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name"), "live")
    live = cells.join(again, "name", "left_semi").groupBy(*key).agg(F.collect_list("cell").alias("at"))
    texts = base.join(live, key).select(*key, "text", "at")
    windows = scratch.save(texts.mapInArrow(lambda it: window_batches(it, size), f"{of_key}, start long, n1 long, n2 long"), "windows")
    scratch.drop("cells")
    again = scratch.save(windows.groupBy("n1", "n2").agg(F.count("*").alias("n")).filter("n > 1").select("n1", "n2"), "again")
    part = windows.join(again, ["n1", "n2"], "left_semi").select(*key, F.col("start").alias("lo"), (F.col("start") + size).alias("hi"))

    def extents(spans: DataFrame) -> DataFrame:
        # strings that begin in one cell of ``size`` bytes overlap, so a cell needs only its extent
        cell = spans.groupBy(*key, F.floor(F.col("lo") / size).alias("cell"))
        return cell.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*key, "lo", "hi")

    part = scratch.save(extents(part), "part")
    scratch.drop("windows", "again")
    whole = scratch.save(extents(whole), "whole")
    scratch.drop("anchors", "names", "pairs")
    spans = whole.unionByName(part)
    by_doc = spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("s"))
    full = rows.join(by_doc, key, "left")
    lows = F.transform("s", lambda x: x["lo"])
    highs = F.transform("s", lambda x: F.least(x["hi"], F.octet_length("text").cast("long")))
    full = full.select("doc_id", "text", lows.alias("lows"), highs.alias("highs"), *(["own"] if with_text else []))
    schema = f"doc_id {full.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        schema += f", kept_text string, removed array<struct<start: bigint, stop: bigint>>, own {full.schema['own'].dataType.simpleString()}"
    return full.mapInArrow(lambda it: strip_batches(it, with_text), schema)
