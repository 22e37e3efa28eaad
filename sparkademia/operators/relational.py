"""Reusable relational shapes: ranking, first and last rows, gaps, unions of arrays, round robin, exploding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each group. Spark cuts each group to `n` rows before the shuffle, so a group with a third of
    all rows moves n rows a mapper. The order should end in a unique column; ties are broken arbitrarily otherwise."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= n).drop("__place")


def dedupe(df: DataFrame, keys: Sequence[str], order: str, keep: str = "first") -> DataFrame:
    """One row per key: the first or last by `order`. Null keys are one group. The whole row is one aggregate, combined
    before the shuffle."""
    row = F.struct(*df.columns)
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(pick(row, F.col(order)).alias("__r")).select("__r.*")


def dense_ids(df: DataFrame, key: Column, order: Column, name: str) -> DataFrame:
    """(key, name): ids from 1 in the order in which keys are first met. Ids come from a range-partitioned sort and each
    partition's count, so no task sees all keys."""
    firsts = df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.min(order).alias("__first"))
    return with_row_numbers(firsts, ["__first", "key"], name).select("key", name)


def with_row_numbers(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in the order of some columns over the whole table, without a single-task window: rows are range
    partitioned and sorted, and each partition starts after the counts of those before. Counts, one a partition, are all
    that the driver sees."""
    from sparkademia.session import Workspace

    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = Workspace(df.sparkSession, "numbers").write(
        parts.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")), "sorted"
    )
    counts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("low")).orderBy("__p").collect()
    before, rows = start, []
    for r in counts:
        rows.append((r["__p"], before - r["low"]))
        before += r["n"]
    shift = df.sparkSession.createDataFrame(rows, "__p int, __shift long")
    return placed.join(F.broadcast(shift), "__p").withColumn(name, F.col("__m") + F.col("__shift")).drop("__p", "__m", "__shift")


def gaps(df: DataFrame, key: str, time: str, item: str, order: Sequence[str]) -> DataFrame:
    """The times between successive different items of each key: repeats of an item directly after it are one attempt.
    Result: key, item, time, gap (to the previous attempt), retry_gap (to the previous row, for repeats)."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("__pi", F.lag(item).over(w)).withColumn("__pt", F.lag(time).over(w)).withColumn("__rn", F.row_number().over(w))
    rows = rows.withColumn("__retry", (F.col("__rn") > 1) & F.col(item).eqNullSafe(F.col("__pi")))
    last = F.last(F.when(~F.col("__retry"), F.col(time)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__last", last)
    gap = F.when(~F.col("__retry"), F.col(time) - F.col("__last"))
    return rows.select(key, item, time, gap.alias("gap"), F.when(F.col("__retry"), F.col(time) - F.col("__pt")).alias("retry_gap"))


def neighbours(lines: Column, before: int, after: int) -> Column:
    """For each element of an array the elements around it joined by a blank. No shuffle."""
    return F.transform(
        lines,
        lambda x, i: F.array_join(F.slice(lines, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before)) + 1 + after), " "),
    )


def round_robin(df: DataFrame, group_order: str, position: str, item: str, limit: int) -> DataFrame:
    """The first `limit` different items, taken one from each group in turn. Each item counts where it comes first."""
    firsts = df.groupBy(item).agg(F.min(F.struct(position, group_order)).alias("__at"))
    return firsts.select(item, f"__at.{position}", f"__at.{group_order}").orderBy(position, group_order, item).limit(limit)


def largest_remainder(weights: DataFrame, total: int, name: str, weight: str, order: str) -> DataFrame:
    """`total` split by weights that sum to 1: whole parts first, the rest to the largest remainders, ties in `order`.
    Weights are configuration: few rows."""
    exact = F.col(weight).cast("double") * total
    rows = weights.select(name, order, exact.alias("__e"), F.floor(exact).alias("__n"))
    rest = F.lit(total) - F.sum("__n").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy((F.col("__e") - F.col("__n")).desc(), order))
    return rows.select(name, order, (F.col("__n") + F.when(place <= rest, 1).otherwise(0)).cast("long").alias("count"))


def page_tree(pages: DataFrame, branch: int) -> DataFrame:
    """The parent and depth of pages 0..n of a site in a tree of `branch` children a page. pages: host, n."""
    i = F.explode(F.sequence(F.lit(0), F.col("n"))).alias("page")
    rows = pages.select("host", i)
    parent = F.when(F.col("page") > 0, F.floor((F.col("page") - 1) / branch))
    # page i lies at the depth d whose first page, (b^d - 1) / (b - 1), is the last one not above i
    if branch == 1:
        depth = F.col("page")
    else:
        firsts = [(branch**d - 1) // (branch - 1) for d in range(64) if (branch**d - 1) // (branch - 1) < 2**62]
        depth = F.size(F.filter(F.array(*[F.lit(x) for x in firsts]), lambda x: x <= F.col("page"))) - 1
    return rows.select("host", "page", parent.cast("long").alias("parent"), depth.cast("long").alias("depth"))


def courses_per_run(runs: DataFrame, queue: DataFrame, programs: DataFrame) -> DataFrame:
    """(run_id, courses): the different programmes whose source_url is a url that a run has fetched (status done); 0 for runs
    without. Urls are made distinct per run and programmes per url before the join, so that a url which comes back in a
    third of all rows meets its programmes once a run; null urls match nothing."""
    done = queue.where("status = 'done'").select("run_id", "url").distinct()
    own = programs.select(F.col("id").alias("__p"), F.col("source_url").alias("url")).distinct()
    n = done.join(own, "url").groupBy("run_id").agg(F.countDistinct("__p").alias("n"))
    return runs.select(F.col("id").alias("run_id")).join(n, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("courses"))
