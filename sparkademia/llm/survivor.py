"""The best representative of each group of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkademia.llm.canonical import with_program_key
from sparkademia.operators.relational import top_per_group
from sparkademia.session import Workspace

#: Trust of a quality flag, highest first; anything else is as good as missing.
QUALITY = {"high": 2, "low": 1}


def _trust(flag: Column) -> Column:
    out = F.lit(0)
    for name, value in QUALITY.items():
        out = F.when(flag == name, F.lit(value)).otherwise(out)
    return out


def _ranked(programs: DataFrame, with_online: bool) -> DataFrame:
    """The best row of each group with the next one's time and what the whole group has.

    The ranking is a window of which two places are asked for, so Spark cuts each group to two rows a mapper before the
    shuffle, and a group with a third of all rows moves no more than that; what the whole group has are aggregates, combined
    before the shuffle. Both are spread by the key, so their join moves nothing. The keys are computed once and written."""
    rows = with_program_key(
        programs.where(F.col("id").isNotNull()),
        "id",
        F.col("last_seen").alias("seen"),
        _trust(F.col("quality_flag")).alias("trust"),
        F.col("quality_flag").isNotNull().alias("flagged"),
        F.col("is_online").alias("online"),
    )
    rows = Workspace(programs.sparkSession, "survivors").write(rows, "keyed")
    one = lambda c: F.when(c, 1).otherwise(0)
    rows = rows.withColumn("filled", one(F.col("seen").isNotNull()) + one(F.col("online").isNotNull()) + one(F.col("flagged")))
    order = [F.col("seen").desc_nulls_last(), F.col("trust").desc(), F.col("filled").desc(), F.col("id").asc()]
    top = top_per_group(rows, ["key"], order, 2)
    w = Window.partitionBy("key").orderBy(*order)
    top = top.withColumn("place", F.row_number().over(w)).withColumn("next_seen", F.lead("seen").over(w)).where("place = 1")
    has = F.col("online").isNotNull()
    group = [F.count(F.lit(1)).alias("copies"), F.max("trust").alias("top_trust"), F.max(one(has)).alias("any_online")]
    if with_online:
        best = F.struct("trust", "seen", "filled", -F.col("id"))
        group.append(F.max(F.when(has, F.struct(best.alias("by"), "online"))).getField("online").alias("best_online"))
    whole = rows.groupBy(F.col("key").alias("of")).agg(*group)
    return top.join(whole, F.col("key") == F.col("of"))


def survivors(programs: DataFrame) -> DataFrame:
    """One row per programme: the surviving row's id and the group's best value of each field.

    Rows are copies as in `canonical.with_program_key`. They are ranked by recency (last_seen, missing last), trust
    (quality_flag high, low, missing), completeness and, as tie-break, the lowest id. Field by field: last_seen is the
    latest, quality_flag the most trusted, is_online that of the most trusted row (then latest, fullest, lowest id) that
    has one. `copies` counts the group's rows; `row_keeps_all` says whether the surviving row alone has every best value.
    Rows without id are left out; repeated rows are copies; an empty table gives no rows; other columns aren't read.
    """
    flag = F.lit(None).cast("string")
    for name, value in QUALITY.items():
        flag = F.when(F.col("top_trust") == value, F.lit(name)).otherwise(flag)
    return _ranked(programs, True).select(
        "id",
        F.col("seen").alias("last_seen"),
        flag.alias("quality_flag"),
        F.col("best_online").alias("is_online"),
        "copies",
        (
            (F.col("trust") == F.col("top_trust")) & F.col("online").eqNullSafe(F.col("best_online"))
        ).alias("row_keeps_all"),
    )


def clear_survivors(programs: DataFrame) -> DataFrame:
    """The id of the surviving row of each group of two or more where recency, trust and completeness agree: its
    last_seen is later than every other row's (missing is earliest), none has a better quality_flag, and its is_online
    is filled or missing in the whole group."""
    later = F.col("seen").isNotNull() & (F.col("next_seen").isNull() | (F.col("next_seen") < F.col("seen")))
    complete = F.col("online").isNotNull() | (F.col("any_online") == 0)
    return _ranked(programs, False).where((F.col("copies") > 1) & later & (F.col("trust") == F.col("top_trust")) & complete).select("id")
