"""A versioned store of Parquet tables with atomic commits over several tables.

A commit stages the new data of its tables under a name of its own and then
publishes one manifest by renaming it into place.  Readers resolve the newest
manifest, so they see all of a commit or nothing of it, and a commit that fails
leaves only staged files behind.  All access is through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SORTED, TABLES, Conflict


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/_manifests"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(f"{self.path}/_manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"tables": {name: [paths]}, "batches": [ids]} of a version, by default the newest."""
        version = (self.versions() or [0])[-1] if version is None else version
        if not version:
            return {"tables": {}, "batches": []}
        text = self.spark.read.text(f"{self.path}/_manifests/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        parts = self.manifest(version)["tables"].get(table, [])
        schema = TABLES[table]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def tables(self) -> dict[str, DataFrame]:
        return {t: self.read(t) for t in TABLES}

    def commit(self, add: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, batch: str | None = None, expect: int | None = None) -> int:
        """Publish rows to add and tables to replace; a batch id that was committed adds nothing.

        Of two writers at once the second finds its version taken.  A commit that only
        adds then follows the other with the files it has staged; one that replaces a
        table, or that ``expect``s a version, is a Conflict and changes nothing.
        """
        before = (self.versions() or [0])[-1] if expect is None else expect
        now = self.manifest(before)
        if batch is not None and batch in now["batches"]:
            return before
        name = f"_data/{uuid.uuid4().hex}"
        staged: list[tuple[bool, str]] = []
        for keep, frames in ((True, add or {}), (False, replace or {})):
            for t, df in frames.items():
                schema = TABLES[t]
                have = set(df.columns)
                whole = df.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
                if t in SORTED:
                    whole = whole.repartitionByRange(*SORTED[t]).sortWithinPartitions(*SORTED[t])
                whole.write.parquet(f"{self.path}/{name}/{t}")
                staged.append((keep, t))
        while True:
            tables = dict(now["tables"])
            for keep, t in staged:
                tables[t] = [*(tables.get(t, []) if keep else []), f"{name}/{t}"]
            try:
                self._publish(before + 1, {"tables": tables, "batches": [*now["batches"], *([batch] if batch else [])]})
                return before + 1
            except Conflict:
                if expect is not None or replace:
                    raise
                before = self.versions()[-1]
                now = self.manifest(before)
                if batch is not None and batch in now["batches"]:
                    return before

    def compact(self) -> int:
        """Rewrite every table that has many parts as one; rows stay as they are."""
        before = (self.versions() or [0])[-1]
        parts = self.manifest(before)["tables"]
        return self.commit(replace={t: self.read(t, before) for t, p in parts.items() if len(p) > 1}, expect=before)

    def _publish(self, version: int, manifest: dict) -> None:
        staged = self._Path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(staged)
        out.write(json.dumps(manifest).encode())
        out.close()
        final = self._Path(f"{self.path}/_manifests/{version:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            self._fs.delete(staged, False)
            raise Conflict(f"version {version} was published by another writer")
