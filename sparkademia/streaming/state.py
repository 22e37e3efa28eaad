"""Keyed state over streams: first sights with a lifetime, and reserved slots per domain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, DateType, DecimalType, IntegralType, StringType

TTL_30_DAYS = 30 * 24 * 3600


def _pack(since: dict[str, int]) -> bytes:
    """Keys and the times (microseconds) at which their lifetimes began, as a compressed Arrow stream."""
    batch = pa.record_batch([pa.array(list(since), pa.large_string()), pa.array(list(since.values()), pa.int64())], ["key", "since"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpack(packed: bytes) -> dict[str, int]:
    t = pa.ipc.open_stream(packed).read_all()
    return dict(zip(t["key"].to_pylist(), t["since"].to_pylist()))


def first_seen(tasks: DataFrame, key: str, time: str, ttl_sec: int = TTL_30_DAYS, groups: int = 4096) -> DataFrame:
    """The rows of a stream whose key wasn't seen within the lifetime that began with its first sight; later sights don't
    extend it. Time is the rows' own; the watermark trails by the lifetime, so that state is dropped when it can't matter.

    Rows without key or time are dropped. Rows of one key and time count in arrival order.

    A call of Python costs milliseconds however few rows it gets, so keys share `groups` states by their hash; each holds its
    keys whole, so equal hashes don't matter. A task holds one group at a time: its living keys and the rows that a
    micro-batch brings it. A micro-batch writes the states of the groups that it touches; with billions of living keys take
    more groups. The number belongs to the checkpoint. Keys whose text may not tell them apart (floats, timestamps, binary,
    nested, collated) have a state each.
    """
    names, kind, ttl = tasks.columns, tasks.schema[key].dataType, ttl_sec * 1_000_000
    text = kind == StringType()
    shared = text or isinstance(kind, (IntegralType, DecimalType, DateType, BooleanType))

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since = _unpack(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames), ignore_index=True)
        at = rows["__at"].to_numpy()
        order = at.argsort(kind="stable")
        kept = []
        for i, k, t in zip(order.tolist(), rows[key if text else "__key"].to_numpy()[order].tolist(), at[order].tolist()):
            began = since.get(k)
            if began is None or t >= began + ttl:
                since[k] = t
                kept.append(i)
        passed = state.getCurrentWatermarkMs() * 1000
        since = {k: t for k, t in since.items() if t + ttl > passed}
        if since:
            state.update((_pack(since),))
            state.setTimeoutTimestamp(-(-(max(since.values()) + ttl) // 1000))
        elif state.exists:
            state.remove()
        if kept:
            yield rows.loc[kept, names]

    rows = tasks.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, f"{ttl_sec} seconds")
    rows = rows.withColumn("__at", F.unix_micros(F.col(time).cast("timestamp")))
    if not text:
        rows = rows.withColumn("__key", F.col(key).cast("string") if shared else F.lit(""))
    group = F.pmod(F.xxhash64(key), F.lit(groups)) if shared else F.col(key)
    return rows.withColumn("__group", group).groupBy("__group").applyInPandasWithState(run, tasks.schema, "seen binary", "append", GroupStateTimeout.EventTimeTimeout)


def first_seen_native(tasks: DataFrame, keys: list[str], time: str, ttl_sec: int = TTL_30_DAYS) -> DataFrame:
    """Like first_seen with Spark's own operator, which keeps its state in the JVM and scales to billions of keys: rows of
    one key within the lifetime of the first give one row. Within one micro-batch any of them may be the one. Rows with a
    null in a key or without time are dropped."""
    ok = F.col(time).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return tasks.where(ok).withWatermark(time, f"{ttl_sec} seconds").dropDuplicatesWithinWatermark(keys)


def next_slots(arrivals: list[float], delays: list[float], stored: float | None) -> tuple[list[float], float | None]:
    """The start of each request of a domain in order: not before it arrives, nor before the slot that the one before it
    has left. A delay of 0 or less takes no slot."""
    out = []
    for t, d in zip(arrivals, delays):
        if d <= 0:
            out.append(t)
            continue
        start = t if stored is None else max(t, stored)
        stored = start + d
        out.append(start)
    return out, stored


def completed(stored: float | None, done_at: float, delay: float) -> float | None:
    """The next free slot after a completion: at least the delay after it; a later slot isn't brought forward."""
    if delay <= 0:
        return stored
    return done_at + delay if stored is None else max(stored, done_at + delay)


SLOTS = "domain string, url string, kind string, at double, start double, wait_sec double"
IDLE_SEC = 600


def reserve_slots(requests: DataFrame, idle_sec: int | None = IDLE_SEC) -> DataFrame:
    """Start and waiting time of each request of a stream. requests: domain, url, kind (reserve or done), at (epoch
    seconds), delay. A `done` row pushes the domain's next slot back and comes out with wait 0. A domain's slot is
    forgotten after `idle_sec` of the clock without rows; with None never, as for a stream that ends (Spark goes on with
    empty batches for as long as a clock timeout may strike).

    Rows of a domain are handled one after another; domains are spread over the tasks. A domain's rows of one micro-batch
    are ordered as a whole by at, url and kind, however many Arrow chunks bring them, and held in one task's memory for it;
    rows that come later than their micro-batch take the next free slot.
    """

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.get[0] if state.exists else None
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["at", "url", "kind"], kind="stable")
        start = []
        for kind, at, delay in zip(rows["kind"], rows["at"], rows["delay"]):
            if kind == "done":
                stored = completed(stored, at, delay)
                start.append(at)
            else:
                s, stored = next_slots([at], [delay], stored)
                start += s
        rows = rows.assign(start=start)
        rows["wait_sec"] = rows["start"] - rows["at"]
        yield rows[["domain", "url", "kind", "at", "start", "wait_sec"]]
        if stored is not None:
            state.update((stored,))
        if idle_sec is not None:
            state.setTimeoutDuration(idle_sec * 1000)

    rows = requests.where(F.col("domain").isNotNull()).select("domain", "url", "kind", F.col("at").cast("double"), F.col("delay").cast("double"))
    timeout = GroupStateTimeout.NoTimeout if idle_sec is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("domain").applyInPandasWithState(run, SLOTS, "stored double", "append", timeout)


def reserve_slots_batch(requests: DataFrame) -> DataFrame:
    """The same for a finished table (domain, url, at, delay), in closed form and without Python: with one delay a domain,
    request i can't start before any earlier one's arrival plus the delays in between, so start_i is i * delay plus the
    running maximum of at_j - j * delay. Requests whose delay is 0 or less start when they arrive."""
    from pyspark.sql import Window

    rows = requests.where(F.col("domain").isNotNull())
    w = Window.partitionBy("domain", "delay").orderBy("at", "url")
    n = (F.row_number().over(w) - 1) * F.col("delay")
    running = F.max(F.col("at") - F.col("__n")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    start = F.when(F.col("delay") > 0, F.col("__n") + running).otherwise(F.col("at"))
    return rows.withColumn("__n", n).select("domain", "url", "at", "delay", start.alias("start")).withColumn("wait_sec", F.col("start") - F.col("at"))


