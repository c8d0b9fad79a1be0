"""Ingest jobs: a log of state changes, claims, the reaper, status and health, and a folder intake.

The queue is the log of states in the store's job table; a job's newest row is
its state.  A claim is a commit that expects the version it was read from, so of
two workers that want the same jobs one has to look again.

Jobs may also be dropped as files into a folder, which is read as a stream: the
stream's checkpoint sees to it that each file is taken in once, and a batch that
is replayed after a crash carries the same id, which the store's manifest knows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import payload_kind
from ..schema import Settings, Status

JOB_SCHEMA = "id string, source string, namespace string, chunk_strategy string, payload binary, enqueued_at timestamp"


def latest(log: DataFrame) -> DataFrame:
    """The newest state of each job of a log of state rows."""
    cols = [c for c in log.columns if c != "id"]
    rank = {s.value: k for k, s in enumerate(Status)}
    order = F.struct("updated_at", "attempt_count", F.coalesce(*[F.when(F.col("status") == s, F.lit(k)) for s, k in rank.items()]))
    top = log.groupBy("id").agg(F.max_by(F.struct(*cols), order).alias("s"))
    return top.select("id", "s.*")


def claim(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The ``n`` oldest queued jobs, running; a job's first start stays its start."""
    first = jobs.filter(F.col("status") == Status.QUEUED.value).orderBy(F.col("enqueued_at").asc(), F.col("id").asc()).limit(n)
    return first.withColumns({"status": F.lit(Status.RUNNING.value), "attempt_count": F.col("attempt_count") + 1, "started_at": F.coalesce("started_at", now), "updated_at": now})


def finish(jobs: DataFrame, now: Column, error: Column | None = None) -> DataFrame:
    """Terminal states: failed where there is an error, else completed.  Failures aren't retried."""
    err = error if error is not None else F.lit(None).cast("string")
    return jobs.withColumns({"status": F.when(err.isNotNull(), Status.FAILED.value).otherwise(Status.COMPLETED.value), "error": err, "finished_at": now, "updated_at": now})


def reap(jobs: DataFrame, now: Column, after_seconds: int = 300, max_attempts: int = 3) -> DataFrame:
    """All jobs, with running ones that have gone stale requeued or, out of attempts, failed."""
    stale = (F.col("status") == Status.RUNNING.value) & (F.col("updated_at") < now - F.make_interval(secs=F.lit(after_seconds)))
    again = stale & (F.col("attempt_count") < max_attempts)
    note = F.concat_ws("; ", "error", F.lit("gave up after too many attempts")) if "error" in jobs.columns else None
    out = {
        "status": F.when(again, Status.QUEUED.value).when(stale, Status.FAILED.value).otherwise(F.col("status")),
        "updated_at": F.when(stale, now).otherwise(F.col("updated_at")),
    }
    if note is not None:
        out["error"] = F.when(stale & ~again, note).otherwise(F.col("error"))
    return jobs.withColumns(out)


def summary(jobs: DataFrame) -> DataFrame:
    """(status, n) of all four states, zeros included."""
    every = jobs.sparkSession.createDataFrame([(s.value,) for s in Status], "status string")
    return every.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def health(jobs: DataFrame, settings: Settings = Settings(), version: str = "0.1.0", schema_version: int = 1) -> DataFrame:
    """One row: version, schema_version, queue_depth, extract_concurrency, last_error."""
    waiting = F.count(F.when(F.col("status").isin(Status.QUEUED.value, Status.RUNNING.value), 1))
    last = F.max_by("error", F.when(F.col("error").isNotNull(), F.col("updated_at"))) if "error" in jobs.columns else F.lit(None).cast("string")
    return jobs.agg(F.lit(version).alias("version"), F.lit(schema_version).alias("schema_version"), waiting.alias("queue_depth"), F.lit(settings.extract_concurrency).alias("extract_concurrency"), last.alias("last_error"))


def to_sources(jobs: DataFrame) -> DataFrame:
    """Jobs as sources to ingest: (namespace, source, text, seq, chunk_strategy, kind, error).

    Jobs without a payload name a path; their text is joined by the caller.
    """
    kind = payload_kind("payload")
    return jobs.select(
        "id", F.coalesce("namespace", F.lit("default")).alias("namespace"), F.coalesce("source", F.lit("(unnamed)")).alias("source"), F.coalesce("chunk_strategy", F.lit("auto")).alias("chunk_strategy"),
        kind.alias("kind"), F.when(kind == "text", F.col("payload").cast("string")).alias("text"), F.when(kind == "bytes", F.lit("not valid UTF-8")).alias("error"), F.col("enqueued_at").alias("seq"),
    )


def backoff(idle: int) -> int:
    """Seconds to wait after ``idle`` polls that found nothing: 1, 5, 10, 20, then 30."""
    return (1, 5, 10, 20)[idle] if idle < 4 else 30


def enqueue(rows: DataFrame, queue: str) -> None:
    """Append jobs to an intake folder; nothing else is done here."""
    spark = rows.sparkSession
    want = spark.createDataFrame([], JOB_SCHEMA).schema
    have = set(rows.columns)
    rows.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in want]).write.mode("append").parquet(queue)


def queued(rows: DataFrame, now: Column) -> DataFrame:
    """New jobs as they enter the log."""
    at = F.coalesce(F.col("enqueued_at"), now) if "enqueued_at" in rows.columns else now
    return rows.withColumns({"status": F.lit(Status.QUEUED.value), "attempt_count": F.lit(0), "enqueued_at": at, "updated_at": now})


def worker(spark: SparkSession, queue: str, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = True, every: str = "1 second", files_a_batch: int = 8) -> StreamingQuery:
    """Start the intake of a folder: ``handle(jobs, batch_id)`` gets each micro-batch of job files.

    once: take what is there and stop; else poll.
    """
    stream = spark.readStream.schema(JOB_SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(queue)
    out = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()
