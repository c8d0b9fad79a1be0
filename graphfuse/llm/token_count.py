"""Token counts of documents in flat, unindexed token files.

A flat file is nothing but token ids of two or four bytes; documents end at a
separator id and no index says where.  Files are cut into blocks of fixed size,
which are dealt out to tasks as byte ranges.  One vector search a block finds its
separators; documents that cross blocks are stitched by a prefix scan over
small block reports: how many separators a block has and where its last one is.
A document began behind the last separator of an earlier block, and its number
is that of the separators before it.

The scan has two levels: over the blocks of each group of ``GROUP`` blocks, and
over the groups of a file, so a file of any size is no single task's work.  A
separator counts as a token of its document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbuf
from .cluster import Scratch, ship
from .tokens import WordTokens, vocabulary

BLOCK_TOKENS = 1 << 20
#: Blocks of a group of the scan.
GROUP = 1 << 10
END = 49407

SCANNED = "file string, block long, at array<int>, ends long, last long, size long"


def separators(ids: np.ndarray, end: int) -> np.ndarray:
    """Where a block's separators stand."""
    return np.flatnonzero(ids == end).astype(np.int32)


def _open(path: str):
    """A file of the shared store for reading, by Arrow's file systems (local and shared folders, HDFS, S3, GCS)."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, where = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(where)


def scan_batches(it: Iterator[pa.RecordBatch], end: int, width: int, block: int) -> Iterator[pa.RecordBatch]:
    """(file, block, length of the file) to a report a block: its separators, their number and the last one's place in the file."""
    now, source = None, None
    for batch in it:
        for path, k, length in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if path != now:
                if source is not None:
                    source.close()
                now, source = path, _open(path)
            first = k * block
            n = min(block, length // width - first)
            at = separators(np.frombuffer(source.read_at(n * width, first * width), np.dtype(f"<u{width}")), end)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([k], pa.int64()), pa.array([at], pa.list_(pa.int32())), pa.array([len(at)], pa.int64()), pa.array([first + int(at[-1]) if len(at) else -1], pa.int64()), pa.array([n], pa.int64())],
                names=["file", "block", "at", "ends", "last", "size"],
            )
    if source is not None:
        source.close()


def scan_files(files: DataFrame, end: int = END, width: int = 4, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document of the files.

    files: file (a path that every worker can open) and length (bytes; a part of
    a token at the end counts for nothing).  start: tokens before the document.
    Tokens after a file's last separator are a document that isn't closed; empty
    files add nothing.
    """
    spark = files.sparkSession
    ship(spark)
    scratch = Scratch(spark, "separators")
    n_blocks = F.ceil(F.floor(F.col("length") / width) / block).cast("long")
    ranges = files.filter(F.col("length") >= width).select("file", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"), F.col("length").cast("long").alias("length"))
    # neighbouring blocks of a file go to one task, which opens it once
    ranges = ranges.repartition("file", F.floor(F.col("block") / 16)).sortWithinPartitions("file", "block")
    seen = scratch.save(ranges.mapInArrow(lambda it: scan_batches(it, end, width, block), SCANNED), "blocks")

    small = seen.drop("at").withColumn("of", F.floor(F.col("block") / GROUP))
    own = W.partitionBy("file", "of").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    groups = small.groupBy("file", "of").agg(F.sum("ends").alias("g_ends"), F.max("last").alias("g_last"))
    upto = W.partitionBy("file").orderBy("of").rowsBetween(W.unboundedPreceding, -1)
    final = F.lead("of").over(W.partitionBy("file").orderBy("of")).isNull()
    groups = groups.select("file", "of", F.sum("g_ends").over(upto).alias("g_ends"), F.max("g_last").over(upto).alias("g_last"), final.alias("final"))
    x = small.join(groups, ["file", "of"])
    before = F.coalesce(F.sum("ends").over(own), F.lit(0)) + F.coalesce("g_ends", F.lit(0))
    opened = F.greatest(F.coalesce(F.max("last").over(own), F.lit(-1)), F.coalesce("g_last", F.lit(-1))) + 1
    newest = F.lead("block").over(W.partitionBy("file", "of").orderBy("block")).isNull() & F.col("final")
    x = x.select("file", "block", before.alias("before"), opened.alias("opened"), newest.alias("newest"))

    x = seen.join(x, ["file", "block"])
    base = F.col("block") * block
    row = lambda start, n, closed: F.struct(start.cast("long").alias("start"), n.cast("long").alias("n"), F.lit(closed).alias("closed"))
    # each separator ends the document that began behind the one before it
    closed = F.transform("at", lambda a, i: F.when(i == 0, row(F.col("opened"), base + a + 1 - F.col("opened"), True)).otherwise(row(base + F.element_at("at", i) + 1, a - F.element_at("at", i), True)))
    rest = F.when(F.col("last") >= 0, F.col("last") + 1).otherwise(F.col("opened"))
    size = base + F.col("size")
    none = F.array().cast("array<struct<start: bigint, n: bigint, closed: boolean>>")
    left = F.when(F.col("newest") & (size > rest), F.array(row(rest, size - rest, False))).otherwise(none)
    out = x.select("file", "before", F.posexplode(F.concat(closed, left)).alias("pos", "doc"))
    return out.select("file", (F.col("before") + F.col("pos")).alias("ordinal"), F.col("doc.start").alias("start"), F.col("doc.n").alias("n_tokens"), F.col("doc.closed").alias("closed"))


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files under ``path``; their content isn't read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def write_token_files(docs: DataFrame, path: str, end: int = END, vocabulary_path: str | None = None, width: int = 2) -> None:
    """Flat token files of a corpus, one a partition of ``docs``: each text's ids and the separator.

    Null and empty texts are a separator alone.  The separator's name in a text is
    encoded as ordinary text, so that no text is cut.  Spark's text sink writes them
    (its line separator is the separator id), so lost tasks leave no half files.
    """
    ship(docs.sparkSession)
    where = vocabulary_path or vocabulary()
    name = WordTokens.of(where).tokenizer.id_to_token(end)
    text = F.replace("text", F.lit(name), F.lit(f"{name[:1]} {name[1:]}")) if name else F.col("text")
    kind = np.dtype(f"<u{width}")

    def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of(where)
        for batch in it:
            for _, _, off, data in textbuf.runs(batch.column(0)):
                ids, start = tokens.encode(off, data)
                if len(ids) and int(ids.max()) > np.iinfo(kind).max:
                    raise ValueError(f"ids of this vocabulary need more than {width} bytes")
                if (ids == end).any():
                    raise ValueError("the separator id stands inside a text")
                raw = ids.astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[a * width : b * width] for a, b in zip(start[:-1], start[1:], strict=True)], pa.binary())], names=["ids"])

    ids = docs.select(text.alias("text")).mapInArrow(encoded, "ids binary")
    separator = np.array([end], kind).tobytes().decode("iso-8859-1")
    ids.select(F.col("ids").cast("string").alias("value")).write.mode("overwrite").option("encoding", "iso-8859-1").option("lineSep", separator).text(path)


def corpus_counts(docs: DataFrame, end: int = END, vocabulary_path: str | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """Token counts of a corpus by way of its flat token files, which are written to the shared folder first.

    (file, ordinal, start, n_tokens, closed); a file's documents are those of one
    partition of ``docs`` in their order.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    path = f"{scratch.top}/flat"
    write_token_files(docs, path, end, vocabulary_path)
    return scan_files(token_files(docs.sparkSession, path), end, 2, block)
