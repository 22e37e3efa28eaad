"""Aggregation through joins when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMBINE = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}


def _state(df: DataFrame, keys: Mapping[str, Column], aggs: Mapping[str, tuple[str, Column]], side: str) -> DataFrame:
    """One compact row per key: the row count and the decomposable state of each aggregate."""
    cols = [c.alias(f"__k_{n}") for n, c in keys.items()]
    values = [v.alias(f"__v_{n}") for n, (_, v) in aggs.items()]
    rows = df.select(*cols, *values)
    out = [F.count(F.lit(1)).alias(f"__{side}_n")]
    for name, (kind, _) in aggs.items():
        v = F.col(f"__v_{name}")
        fn = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[kind]
        out.append(fn(v).alias(f"__{side}_{name}"))
    return rows.groupBy(*[f"__k_{n}" for n in keys]).agg(*out)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    left_keys: Mapping[str, Column],
    right_keys: Mapping[str, Column],
    group: Sequence[str],
    left_aggs: Mapping[str, tuple[str, Column]] = {},
    right_aggs: Mapping[str, tuple[str, Column]] = {},
    how: str = "left",
) -> DataFrame:
    """The aggregates of left JOIN right grouped by some of the join keys, without building the join's rows.

    Both inputs are first aggregated by the whole join key; map-side combining leaves each mapper with one row per key,
    so a key with a third of all rows costs its reducer no more than one row per mapper. The compact states are joined,
    and the aggregates of the join follow by algebra: a pair count is the product of both counts, a sum over the join is
    one side's sum times the other side's count, minima and maxima carry over. The states are then rolled up to `group`.

    left_keys/right_keys: join key name -> expression, the same names on both sides.
    left_aggs/right_aggs: name -> (kind, expression), kind one of count, sum, min, max.
    Result: the group columns; `left_rows` and `right_rows` (each side's own rows); `pairs` (rows of the join); for each
    left aggregate its value over the left rows (`name`) and, for sums and counts, over the join (`name_joined`);
    likewise for the right.

    A null key is its own group on the left and matches nothing, as in SQL; with how="inner" it disappears. Empty inputs
    give no rows. Repeated rows count as often as they occur. Other columns of the inputs, whatever their names, aren't
    read.
    """
    if set(left_keys) != set(right_keys):
        raise ValueError("both sides need the same key names")
    if not set(group) <= set(left_keys):
        raise ValueError("group must be some of the join keys")
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    names = list(left_keys)
    a = _state(left, left_keys, left_aggs, "l").alias("a")
    b = _state(right, {n: right_keys[n] for n in names}, right_aggs, "r").alias("b")
    on = [F.col(f"a.__k_{n}") == F.col(f"b.__k_{n}") for n in names]
    joined = a.join(b, on, how)
    ln, rn = F.col("__l_n"), F.coalesce(F.col("__r_n"), F.lit(0))
    fan = F.greatest(rn, F.lit(1)) if how == "left" else rn
    out = [F.sum(ln).alias("left_rows"), F.sum(rn).alias("right_rows"), F.sum(ln * fan).alias("pairs")]
    for side, aggs, times in (("l", left_aggs, fan), ("r", right_aggs, ln)):
        for name, (kind, _) in aggs.items():
            state = F.col(f"__{side}_{name}")
            value = F.coalesce(state, F.lit(0)) if kind == "count" else state
            out.append(getattr(F, _COMBINE[kind])(value).alias(name))
            if kind in ("count", "sum"):
                out.append(F.sum(value * times).alias(f"{name}_joined"))
    return joined.groupBy(*[F.col(f"a.__k_{g}").alias(g) for g in group]).agg(*out)


def frequent_keys(states: DataFrame, rows: str, share: float) -> DataFrame:
    """The rows of `states` whose count is at least `share` of the total. There are at most 1/share of them, whatever the
    input, so the result may be broadcast. The total is a scalar subquery over the same compact states."""
    total = states.agg(F.sum(rows)).scalar()
    return states.where(F.col(rows) >= total * F.lit(share))
