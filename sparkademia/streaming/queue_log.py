"""The crawl's event stream written to its log tables in micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkademia import schemas
from sparkademia.operators.merge import MergeRule, current, last_values, swap, upsert, versions


def read_tasks(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Tasks as they arrive in a folder of JSON lines. Malformed ones, and ones without url or domain, are skipped."""
    reader = spark.readStream.schema(schemas.TASK.add("_corrupt_record", "string")).option("mode", "PERMISSIVE")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.json(path)
    return rows.where("_corrupt_record IS NULL AND url IS NOT NULL AND domain IS NOT NULL").drop("_corrupt_record")


def distinct_tasks(tasks: DataFrame, time: str | None = None, late: str = "30 days") -> DataFrame:
    """Each (domain, url, depth) once. With a time column, once within `late` of its first sight, after which its state is
    dropped; without one, the state of a stream that doesn't end grows with its tasks."""
    keys = ["domain", "url", "depth"]
    return tasks.dropDuplicates(keys) if time is None else tasks.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


@dataclass
class LogTables:
    """Parquet tables below `root`: queue_state (one row per run and url), attempts, failures, edges, tag_scores,
    class_counts. failures_only keeps what went wrong: states of errors, attempts that failed, no edges.

    Keyed tables (queue_state, tag_scores, class_counts) have a version per batch, named by it; logs (the others) have a
    folder per batch and are only ever added to."""

    root: str
    failures_only: bool = False

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, spark: SparkSession, name: str) -> DataFrame | None:
        if name in KEYED:
            return current(spark, self.path(name))
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        return spark.read.parquet(self.path(name)).drop("batch")


KEYED = ("queue_state", "tag_scores", "class_counts")
STATE_KEYS = ("run_id", "url")
#: What a later event overwrites, and what it overwrites only with a value.
STATE_RULE = MergeRule(keys=STATE_KEYS, update=("status", "depth", "domain", "parent_url", "at"), fill=("fetch_method", "worker_id"))


def states_of(events: DataFrame) -> DataFrame:
    """Per run and url the last state of a batch; fetch_method and worker_id are the last that aren't empty."""
    e = events.where("kind = 'state'").withColumn("__order", F.struct("at", "ordinal"))
    return last_values(e, STATE_RULE, "__order").drop("__order")


def _merge(spark: SparkSession, t: LogTables, name: str, batch: int, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """A keyed table's version of a batch, unless it is there already, as when a batch is replayed."""
    found = versions(spark, t.path(name))
    if not found or found[-1] < batch:
        swap(new if not found else combine(current(spark, t.path(name)), new), t.path(name), batch)


def _append(t: LogTables, name: str, batch: int, new: DataFrame) -> None:
    """A log's rows of a batch; a replay writes the same folder again."""
    new.write.mode("overwrite").parquet(f"{t.path(name)}/batch={batch}")


def _add(keys: list[str], sums: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda old, new: old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def apply_batch(events: DataFrame, t: LogTables, batch: int = 0) -> None:
    """One micro-batch: events split by kind, aggregated, and merged into the tables or added to the logs. A batch that fails
    on the way is replayed from the checkpoint under the same number: tables that have its version are left as they are,
    its folders of the logs are written again, so nothing counts twice."""
    spark = events.sparkSession
    e = events.withColumn("ordinal", F.monotonically_increasing_id()).persist()
    try:
        states = states_of(e)
        if t.failures_only:
            states = states.where("status = 'error'")
        _merge(spark, t, "queue_state", batch, states, lambda old, new: upsert(old, new, STATE_RULE, "at"))
        attempts = e.where("kind = 'attempt'").select("run_id", "url", "domain", "fetch_method", "ok", "error_type", "at")
        if t.failures_only:
            # who failed, with the domain, whether or not its state is kept
            _append(t, "failures", batch, attempts.where("NOT ok"))
        else:
            known = t.read(spark, "queue_state").select(*STATE_KEYS)
            _append(t, "attempts", batch, attempts.join(known, list(STATE_KEYS), "left_semi"))
            keys = ["run_id", "parent_url", "url", "source"]
            edges = e.where("kind = 'edge'").select(*keys, "depth", "at").dropDuplicates(keys)
            if t.read(spark, "edges") is not None:
                earlier = spark.read.parquet(t.path("edges")).where(F.col("batch") < batch).select(*keys)
                edges = edges.join(earlier, keys, "left_anti")
            _append(t, "edges", batch, edges)
        keys = ["run_id", "domain", "tag_name", "course_type", "keyword"]
        tags = e.where("kind = 'tag'").groupBy(*keys).agg(F.sum("count").alias("count"), F.sum("score").alias("score"))
        _merge(spark, t, "tag_scores", batch, tags, _add(keys, ["count", "score"]))
        keys = ["run_id", "domain", "tag_name", "class_name"]
        classes = e.where("kind = 'class'").groupBy(*keys).agg(F.sum("count").alias("count"))
        _merge(spark, t, "class_counts", batch, classes, _add(keys, ["count"]))
    finally:
        e.unpersist()


def retried(tasks: DataFrame, handle: Callable[[DataFrame], DataFrame], root: str, most: int = 5) -> Callable[[DataFrame, int], None]:
    """A sink that hands each task out at least once, and again with the next batches while it fails, `most` times in all;
    then it goes to the dead letters. handle: a batch of tasks with `receives` -> the same rows with a column ok. Below
    `root`: done and dead, a folder per batch, and waiting, a version per batch. A replayed batch finds its version of
    `waiting` and hands nothing out again if it was finished. tasks gives the columns."""
    names = tasks.columns
    at = lambda name: f"{root.rstrip('/')}/{name}"

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = versions(spark, at("waiting"))
        if found and found[-1] >= number:
            return
        rows = batch.select(*names, F.lit(0).alias("failed"))
        if found:
            rows = rows.unionByName(current(spark, at("waiting")))
        out = handle(rows.withColumn("receives", F.col("failed") + 1)).persist()
        try:
            bad = out.where(~F.coalesce("ok", F.lit(False)))
            out.where("ok").select(*names, "receives").write.mode("overwrite").parquet(f"{at('done')}/batch={number}")
            bad.where(F.col("receives") >= most).select(*names, "receives").write.mode("overwrite").parquet(f"{at('dead')}/batch={number}")
            swap(bad.where(F.col("receives") < most).select(*names, F.col("receives").alias("failed")), at("waiting"), number)
        finally:
            out.unpersist()

    return run


def numbered_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts with their number within (run, url)."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id", "url").orderBy("at", "ok")
    return attempts.withColumn("attempt_no", F.row_number().over(w))


def start(events: DataFrame, tables: LogTables, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs the stream: all there is and then an end, or a batch every so often."""
    w = events.writeStream.foreachBatch(lambda df, n: apply_batch(df, tables, n)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def write_records(records: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hands batches of a stream to a sink; one that raises stops the query, which then resumes from its checkpoint."""
    w = records.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def is_stalled(progress: list[dict], pending: int, limit_sec: float) -> bool:
    """Whether nothing was read for `limit_sec` while tasks were pending. progress: numInputRows and timestamp (epoch
    seconds) of the last batches, oldest first."""
    if pending <= 0 or not progress:
        return False
    last = max((p["timestamp"] for p in progress if p["numInputRows"] > 0), default=progress[0]["timestamp"])
    return progress[-1]["timestamp"] - last >= limit_sec


def is_finished(pending_counts: list[int], checks: int = 2) -> bool:
    """Whether the last checks in a row found nothing pending."""
    return len(pending_counts) >= checks and not any(pending_counts[-checks:])


def event_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An addition: counts and sums of events per window of event time, with late rows up to a limit."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    )
