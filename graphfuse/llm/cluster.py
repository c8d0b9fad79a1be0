"""Session plumbing for the operators: shipped code, shared scratch tables, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many edges are joined up in one task; more of them by star steps, with the same result.
FEW = 1 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, and Arrow batches of bounded bytes.

    Python workers import the kernels by name, so a worker started elsewhere
    needs the code; Spark's own file server hands the archive out.
    """
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
    if int(spark.version.split(".")[0]) >= 4:
        # a step's shuffle files go when the step has been written
        own["spark.sql.classic.shuffleDependency.fileCleanup.enabled"] = "true"
    told = spark._jsparkSession.sessionState().conf()
    for key, value in own.items():
        if not told.contains(key) and spark.conf.isModifiable(key):  # what the session says itself stays
            spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    fd, name = tempfile.mkstemp(prefix="graphfuse-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir.  Where that is unset and driver and
    executors are one process, a temporary one is made and set; on a cluster that
    is an error, for executors don't see each other's folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="graphfuse-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder.

    ``save`` runs a plan once, writes it as Parquet and hands back a frame that
    reads the files, so later stages don't recompute it and the loss of an
    executor costs no more than the running stage.  Results are lazy and may read
    them until the application ends; then the driver removes the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.top = f"{shared_dir(spark)}/graphfuse-{name}-{uuid.uuid4().hex}"
        self.known = False

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``by``: a column whose values have folders of their own; their files are packed closer."""
        path = f"{self.top}/{name}"
        df.write.mode("overwrite").parquet(path, partitionBy=by, compression="zstd" if by else None)
        if not self.known:
            top = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
            self.known = top.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(top)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self) -> str:
        """The tables' folder with its file system's name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
            path.getFileSystem(conf).delete(path, True)


def settle(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the nodes 0 to n - 1 reaches over the edges (a, b)."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return low
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


def settle_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) to (node, component)."""
    edges = list(it)
    if not sum(x.num_rows for x in edges):
        return
    t = pa.Table.from_batches(edges)
    ends = pa.concat_arrays([c for k in range(2) for c in t.column(k).chunks])
    nodes = pc.unique(ends)
    nodes = nodes.take(pc.sort_indices(nodes))
    at = pc.index_in(ends, value_set=nodes).to_numpy().astype(np.int64)
    low = settle(at[: t.num_rows], at[t.num_rows :], len(nodes))
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([nodes[k : k + (1 << 16)], nodes.take(pa.array(low[k : k + (1 << 16)]))], names=["node", "component"])


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, component) of an undirected edge list (a, b): the smallest reachable node.

    At most FEW edges, of ids that Arrow orders as Spark does, are joined up in
    one task: each star step shuffles several times, whose tasks cost more than
    a few edges do.  More of them take alternating large-star and small-star steps
    (Kiveris et al. 2014): each is one grouped minimum and one join, edges never
    outgrow their first number by more than the nodes, and the number of rounds is
    logarithmic in practice.  Minima are pre-aggregated before the shuffle and
    written before they are joined, so that Spark can split the edges of a hot
    node over tasks.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{tag}-0")
    kind = e.schema["u"].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint", "string", "date") and e.count() <= FEW:
        return e.coalesce(1).mapInArrow(settle_batches, f"node {kind}, component {kind}")
    for step in range(1, 200):
        # large star: every larger neighbour of u is linked with u's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{tag}-low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and u itself are linked with the smallest; no node is hot here
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = scratch.save(small, f"{tag}-{step}")
        scratch.drop(f"{tag}-{step - 1}", f"{tag}-low")
        e = now
        # done when all are stars: no node has two centres, and no centre has one
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("leaf")).unionAll(e.select(F.col("v").alias("x"), F.lit(0).alias("leaf")).distinct())
        if ends.groupBy("x").agg(F.sum("leaf").alias("k"), F.min("leaf").alias("low")).filter("k > 1 or (k = 1 and low = 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
