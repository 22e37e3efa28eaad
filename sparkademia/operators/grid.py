"""Irregular readings onto a regular grid: harmonic regression with trend, and residuals bridged between observations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkademia.session import Workspace


#: A time in words: date, time, fraction, zone.
_DAY = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})[T ]+"
_ZONE = r"(?:Z|z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2})"
_CLOCK = rf"{_DAY}[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}}(?:[.,][0-9]+)?)? *{_ZONE}?$"


def epoch_seconds(text: Column) -> Column:
    """Epoch seconds (double) of a time written as date and time with -, / or . between the date's parts and a blank or T
    before the time, with or without fraction, Z or an offset, or as epoch seconds, milliseconds or microseconds in
    digits. UTC unless an offset is named, whatever the session's zone. Null for anything else, also for days that don't
    exist. Fractions count to the microsecond.

    The text is brought to the one notation that Spark's own cast reads."""
    t = F.trim(text)
    clock = F.upper(F.regexp_replace(F.translate(t, ",", "."), _DAY, "$1-$2-$3T"))
    clock = F.when(t.rlike(_ZONE + "$"), F.translate(clock, " ", "")).otherwise(F.concat(clock, F.lit("Z")))
    minutes = F.regexp_replace(clock, "(T[0-9]{1,2}:[0-9]{2})(?=[^:0-9]|$)", "$1:00")  # without seconds; the cast wants them
    stamp = F.coalesce(clock.try_cast("timestamp"), minutes.try_cast("timestamp"))
    number = t.try_cast("double")
    whole = F.length(F.split_part(t, F.lit("."), F.lit(1)))
    epoch = F.when(whole <= 11, number).when(whole <= 14, number / 1e3).otherwise(number / 1e6)
    return F.when(t.rlike(_CLOCK), F.unix_micros(stamp) / 1e6).when(t.rlike(r"^[0-9]{9,17}(\.[0-9]+)?$"), epoch)


def _basis(t: Column, periods: Sequence[float], harmonics: int) -> list[Column]:
    cols = [F.lit(1.0), t]
    for p in periods:
        for k in range(1, harmonics + 1):
            w = t * F.lit(2 * math.pi * k / p)
            cols += [F.sin(w), F.cos(w)]
    return cols


def _solver(values: int, size: int, ridge: float):
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def solve(gram: pd.Series, moments: pd.Series) -> pd.Series:
        if not len(gram):
            return pd.Series([], dtype=object)
        g = np.stack([np.asarray(x, float) for x in gram])
        m = np.stack([np.asarray(x, float) for x in moments]).reshape(len(g), values, size)
        full = np.zeros((len(g), size, size))
        i, j = np.triu_indices(size)
        full[:, i, j] = g
        full[:, j, i] = g
        # the trend is counted from each key's mean time: shift the basis, solve, shift the solution back
        shift = np.tile(np.eye(size), (len(g), 1, 1))
        shift[:, 1, 0] = -full[:, 0, 1] / np.maximum(full[:, 0, 0], 1.0)
        full = shift @ full @ shift.transpose(0, 2, 1)
        m = m @ shift.transpose(0, 2, 1)
        penalty = ridge * np.maximum(full[:, 0, 0], 1.0)
        np.einsum("nii->ni", full)[:, 1:] += penalty[:, None]
        np.einsum("nii->ni", full)[:, 0] += 1e-9
        out = np.linalg.solve(full, m.transpose(0, 2, 1)).transpose(0, 2, 1) @ shift
        return pd.Series([[list(r) for r in x] for x in out])

    return solve


def regular_grid(
    readings: DataFrame,
    key: str,
    time: Column,
    values: Sequence[str],
    step: int = 30,
    periods: Sequence[float] = (3600.0, 86400.0),
    harmonics: int = 2,
    ridge: float = 1e-3,
    chunk_slots: int = 960,
) -> DataFrame:
    """One row per key and slot of `step` seconds from the key's first to its last usable reading.

    Columns: the key, slot_start (epoch seconds, a multiple of step), filled (no usable reading lies in the slot),
    readings, one column per value. A reading is usable if its key and time are known and every value is present, no NaN
    and not negative. Observed slots have the mean of their readings. Empty slots have the prediction of a regression on
    trend and harmonics of `periods`, plus the residual interpolated between the observed slots before and after, so the
    series meets the observations at both ends; negative predictions become 0.

    The regression's normal equations are sums, taken per key and chunk with map-side combining, so a key with a third of
    all readings is spread; only each key's small system (2 + 2 * harmonics * periods unknowns) is solved in one place.
    Gaps are found within chunks of `chunk_slots` slots; the chunks' first and last slots bridge their borders. A key with
    one slot has one row, without usable readings none. Repeated and late readings are averaged. An empty table gives no
    rows; other columns aren't read. The observed slots are written once, so that each time is parsed once.
    """
    fine = [F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) & (F.col(v) >= 0) for v in values]
    slot = (F.floor(time / step) * step).cast("long")
    named = F.col(key).isNotNull()
    usable = readings.where(named & _all(fine)).select(F.col(key).alias("__k"), slot.alias("__s"), *[F.col(v).cast("double").alias(f"__y{i}") for i, v in enumerate(values)])
    n = len(values)
    slots = (
        usable.groupBy("__k", "__s")
        .agg(F.count(F.lit(1)).alias("__n"), *[F.avg(f"__y{i}").alias(f"__y{i}") for i in range(n)])
        .withColumn("__c", F.floor(F.col("__s") / (step * chunk_slots)).cast("long"))
    )
    # readings without a time are one more row a key, left out after the writing: a filter before it would parse twice
    slots = Workspace(readings.sparkSession, "grid").write(slots, "slots").where(F.col("__s").isNotNull())
    # normal equations; time is counted from the chunk-independent origin 2020 in days to keep the sums small
    t = (F.col("__s") - F.lit(1577836800)) / F.lit(86400.0)
    basis = _basis(t, [p / 86400.0 for p in periods], harmonics)
    size = len(basis)
    named = slots.select("__k", "__c", "__s", *[f"__y{i}" for i in range(n)], *[b.alias(f"__b{j}") for j, b in enumerate(basis)])
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(F.col(f"__b{i}") * F.col(f"__b{j}")).alias(f"g{i}_{j}") for i, j in pairs]
    sums += [F.sum(F.col(f"__b{j}") * F.col(f"__y{i}")).alias(f"m{i}_{j}") for i in range(n) for j in range(size)]
    names = [f"g{i}_{j}" for i, j in pairs] + [f"m{i}_{j}" for i in range(n) for j in range(size)]
    by_chunk = named.groupBy("__k", "__c").agg(*sums, F.min("__s").alias("__first"), F.max("__s").alias("__last"), F.min_by(F.struct(*[F.col(f"__y{i}") for i in range(n)]), "__s").alias("__head"))
    total = by_chunk.groupBy("__k").agg(*[F.sum(x).alias(x) for x in names])
    coefficients = total.select(
        "__k",
        _solver(n, size, ridge)(F.array(*names[: len(pairs)]), F.array(*names[len(pairs) :])).alias("__w"),
    )
    # what follows each chunk, and the coefficients, as one small row per chunk
    w = Window.partitionBy("__k").orderBy("__c")
    borders = by_chunk.select("__k", "__c", F.lead("__first").over(w).alias("__after"), F.lead("__head").over(w).alias("__after_y")).join(coefficients, "__k")
    inside = Window.partitionBy("__k", "__c").orderBy("__s")
    y = F.struct(*[F.col(f"__y{i}") for i in range(n)])
    rows = (
        slots.withColumn("__next", F.lead("__s").over(inside))
        .withColumn("__next_y", F.lead(y).over(inside))
        .join(borders, ["__k", "__c"])
        .withColumn("__next_y", F.coalesce("__next_y", "__after_y"))
        .withColumn("__next", F.coalesce("__next", "__after"))
    )

    def fitted(at: Column, i: int) -> Column:
        b = _basis((at - F.lit(1577836800)) / F.lit(86400.0), [p / 86400.0 for p in periods], harmonics)
        out = F.lit(0.0)
        for j, c in enumerate(b):
            out = out + F.col("__w")[i][j] * c
        return out

    # the slots of a gap in blocks, so that no row carries a long array
    block = 4096 * step
    observed = rows.select(F.col("__k").alias(key), F.col("__s").alias("slot_start"), F.lit(False).alias("filled"), F.col("__n").alias("readings"), *[F.col(f"__y{i}").alias(v) for i, v in enumerate(values)])
    gaps = rows.where(F.col("__next") > F.col("__s") + step)
    gaps = gaps.withColumn("__from", F.explode(F.sequence(F.col("__s") + step, F.col("__next") - step, F.lit(block).cast("long"))))
    gaps = gaps.withColumn("__g", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + (block - step), F.col("__next") - step), F.lit(step).cast("long"))))
    share = (F.col("__g") - F.col("__s")) / (F.col("__next") - F.col("__s"))
    filled = []
    for i, v in enumerate(values):
        before = F.col(f"__y{i}") - fitted(F.col("__s"), i)
        after = F.col("__next_y")[f"__y{i}"] - fitted(F.col("__next"), i)
        filled.append(F.greatest(F.lit(0.0), fitted(F.col("__g"), i) + before + (after - before) * share).alias(v))
    missing = gaps.select(F.col("__k").alias(key), F.col("__g").alias("slot_start"), F.lit(True).alias("filled"), F.lit(0).cast("long").alias("readings"), *filled)
    return observed.unionByName(missing)


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
