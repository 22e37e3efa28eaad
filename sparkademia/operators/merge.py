"""Keyed merges over immutable tables: a new version is computed, written elsewhere, and then takes the old one's place."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkademia.operators.relational import dedupe, with_row_numbers
from sparkademia.session import Workspace


@dataclass(frozen=True)
class MergeRule:
    """keys identify a row; `update` columns are overwritten, `fill` columns only by values that aren't null or empty, all
    others keep their old values. keep: which row of a batch counts for a key. null_keys: match (null equals null) or
    append (a row with a null key is never the same as another)."""

    keys: tuple[str, ...]
    update: tuple[str, ...] = ()
    fill: tuple[str, ...] = ()
    keep: str = "last"
    null_keys: str = "match"


def _no_null(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def collapse_batch(batch: DataFrame, rule: MergeRule, order: str) -> DataFrame:
    """One row per key, first or last by `order`; rows with a null key stay single where they never match."""
    if rule.null_keys == "match":
        return dedupe(batch, rule.keys, order, rule.keep)
    whole = _no_null(rule.keys)
    return dedupe(batch.where(whole), rule.keys, order, rule.keep).unionByName(batch.where(~whole))


def last_values(batch: DataFrame, rule: MergeRule, order: str) -> DataFrame:
    """One row per key: the `update` columns of the last row by `order`, the `fill` columns each of the last row that has a
    value (not null or empty) there, and the last `order`."""
    real = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    last = [F.max_by(c, order).alias(c) for c in rule.update if c != order]
    fill = [F.max_by(c, F.when(real(c), F.col(order))).alias(c) for c in rule.fill]
    return batch.groupBy(*rule.keys).agg(*last, *fill, F.max(order).alias(order))


def upsert(existing: DataFrame, batch: DataFrame, rule: MergeRule, order: str, id_column: str | None = None) -> DataFrame:
    """The table after a batch: matching rows updated by the rule, the others inserted. With `id_column`, new rows get ids
    after the highest one, in the batch's order.

    Existing rows must be unique by key. Columns that the batch lacks are null in new rows. An empty side gives the other.
    Both sides meet in one full outer join.
    """
    names = existing.columns
    new = collapse_batch(batch, rule, order)
    e = existing.select("*", F.lit(True).alias("__old")).alias("e")
    n = new.select(*[F.col(c).alias(f"__n_{c}") for c in new.columns], F.lit(True).alias("__new")).alias("n")
    same = [
        (F.col(f"e.{k}").eqNullSafe(F.col(f"__n_{k}")) if rule.null_keys == "match" else F.col(f"e.{k}") == F.col(f"__n_{k}")) for k in rule.keys
    ]
    types, out = dict(existing.dtypes), []
    old_row, new_row = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    for c in names:
        old, value = F.col(f"e.{c}"), (F.col(f"__n_{c}") if c in new.columns else F.lit(None)).cast(types[c])
        if c in rule.update and c in new.columns:
            kept = F.when(new_row, value).otherwise(old)
        elif c in rule.fill and c in new.columns:
            usable = F.coalesce(value.isNotNull() & (value.cast("string") != ""), F.lit(False))
            kept = F.when(usable, value).otherwise(old)
        else:
            kept = old
        out.append(F.when(old_row, kept).otherwise(value).alias(c))
    joined = e.join(n, same, "full_outer")
    if not id_column:
        return joined.select(*out)
    place = "__place"
    both = Workspace(existing.sparkSession, "upsert").write(joined.select(*out, F.col(f"__n_{order}").alias(place), old_row.alias("__kept")), "joined")
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0))).first()[0]
    fresh = with_row_numbers(both.where("NOT __kept").drop(id_column), [place], id_column, int(top) + 1)
    return both.where("__kept").select(*names).unionByName(fresh.select(*[F.col(c).cast(types[c]).alias(c) for c in names]))


def insert_ignore(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with the batch's rows whose key it lacks, each once."""
    new = batch.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def map_ids(batch: DataFrame, store: DataFrame, keys: Sequence[str], null_safe: Sequence[str] = (), source_id: str = "id", target: str = "stored_id") -> DataFrame:
    """(source_id, target): the stored id of each batch row by its natural key, null-safe on some of the columns; null
    where the store has no such row."""
    s = store.select(F.col("id").alias(target), *[F.col(k).alias(f"__s_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__s_{k}")) if k in null_safe else F.col(k) == F.col(f"__s_{k}") for k in keys]
    return batch.join(s, on, "left").select(source_id, target)


def translate_ids(rows: DataFrame, mapping: DataFrame, column: str, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """rows with `column` translated, and one row that counts what was kept and what was skipped for lack of a match."""
    j = rows.join(mapping.select(F.col(source).alias(column), F.col(target).alias("__t")), column, "left")
    counts = j.agg(F.count("__t").alias("kept"), F.count_if(F.col("__t").isNull()).alias("skipped"))
    return j.where(F.col("__t").isNotNull()).withColumn(column, F.col("__t")).drop("__t"), counts


def load_chunk(chunk, stores: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The four tables after a chunk of transformed records (a `transform.Transform`), and a summary: rows in, inserted and
    skipped of each table. stores: universities, degree_programs, tuition_patterns, program_tuition_map.

    Ids of the chunk are its own. Universities without a name are skipped; programmes without a name or whose university was
    skipped likewise; pairs whose programme or pattern was skipped too. Each table is written before the next one refers to
    its ids.
    """
    spark = stores["universities"].sparkSession
    space, counts, out = Workspace(spark, "load"), {}, {}
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""

    def put(name: str, rows: DataFrame, rule: MergeRule) -> DataFrame:
        before = stores[name].count()
        out[name] = space.write(upsert(stores[name], rows, rule, "id", "id"), name)
        counts[f"{name}_inserted"] = out[name].count() - before
        return out[name]

    u = chunk.universities
    counts["universities_in"], counts["universities_skipped"] = u.count(), u.where(blank("name")).count()
    stored = put("universities", u.where(~blank("name")), MergeRule(keys=("name",), update=("country", "url")))
    ids = map_ids(u, stored, ["name"]).where("stored_id IS NOT NULL").select(F.col("id").alias("university_id"), F.col("stored_id").alias("__u"))
    p = chunk.degree_programs
    named = p.where(~blank("program_name")).join(ids, "university_id").withColumn("university_id", F.col("__u")).drop("__u")
    named = space.write(named, "named")
    counts["degree_programs_in"] = p.count()
    counts["degree_programs_skipped"] = counts["degree_programs_in"] - named.count()
    keys = ("university_id", "source_url", "program_name", "course_type", "is_online")
    stored = put("degree_programs", named, MergeRule(keys=keys, update=("last_seen", "quality_flag"), keep="first"))
    programs = map_ids(named, stored, list(keys), null_safe=keys)
    t = chunk.tuition_patterns
    counts["tuition_patterns_in"] = t.count()
    keys = ("degree_level", "amount", "currency", "fee_type", "tuition_type")
    rule = MergeRule(keys=keys, update=("amount_min", "amount_max", "normalized_monthly_amount", "normalization_note"), null_keys="append")
    stored = put("tuition_patterns", t, rule)
    # a key with a null is in the store as often as it came; any of its rows serves
    one = stored.groupBy(*keys).agg(F.max("id").alias("id"))
    patterns = map_ids(t, one, list(keys), null_safe=keys)
    m = chunk.program_tuition_map
    pairs = m.join(programs.where("stored_id IS NOT NULL").select(F.col("id").alias("degree_program_id"), F.col("stored_id").alias("__p")), "degree_program_id")
    pairs = pairs.join(patterns.where("stored_id IS NOT NULL").select(F.col("id").alias("tuition_pattern_id"), F.col("stored_id").alias("__t")), "tuition_pattern_id")
    pairs = space.write(pairs.select(F.col("__p").alias("degree_program_id"), F.col("__t").alias("tuition_pattern_id")), "pairs")
    counts["program_tuition_map_in"] = m.count()
    counts["program_tuition_map_skipped"] = counts["program_tuition_map_in"] - pairs.count()
    before = stores["program_tuition_map"].count()
    out["program_tuition_map"] = space.write(insert_ignore(stores["program_tuition_map"], pairs, ["degree_program_id", "tuition_pattern_id"]), "map")
    counts["program_tuition_map_inserted"] = out["program_tuition_map"].count() - before
    return out, counts


def run_started(runs: DataFrame, started: DataFrame) -> DataFrame:
    """The runs with new ones (started_at, root_seed_count, notes), which are running and get ids after the highest."""
    new = started.withColumns({"status": F.lit("running"), "finished_at": F.lit(None).cast("timestamp")})
    top = int(runs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    new = with_row_numbers(new, ["started_at"], "id", top + 1)
    types = dict(runs.dtypes)
    return runs.unionByName(new.select(*[F.col(c).cast(types[c]).alias(c) for c in runs.columns]))


def run_finished(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """The runs with status and finished_at of those in `finished` (id, status, finished_at, notes) set; notes only where
    they aren't empty."""
    rule = MergeRule(keys=("id",), update=("status", "finished_at"), fill=("notes",))
    return upsert(runs, finished.join(runs.select("id"), "id", "left_semi"), rule, "finished_at")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a table below `path`, oldest first."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return []
    found = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(_file_system(spark, f"{path}/{name}/_SUCCESS")[1]):
            found.append(int(name[1:]))
    return sorted(found)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest finished version of a table written by `swap`."""
    found = versions(spark, path.rstrip("/"))
    return spark.read.parquet(f"{path.rstrip('/')}/v{found[-1]:012d}") if found else None


def swap(df: DataFrame, path: str, version: int | None = None, keep: int = 2) -> int:
    """Writes a table's next version into a folder of its own; it takes the old one's place when its _SUCCESS mark is there,
    which is one atomic step. A write that fails leaves the old version in place. The last `keep` versions stay for readers
    that began before. The plan may read the old version. Returns the version."""
    spark, path = df.sparkSession, path.rstrip("/")
    known = versions(spark, path)
    version = (known[-1] + 1 if known else 0) if version is None else version
    df.write.mode("overwrite").parquet(f"{path}/v{version:012d}")
    for old in [v for v in known if v != version][: 1 - keep or None]:
        fs, p = _file_system(spark, f"{path}/v{old:012d}")
        fs.delete(p, True)
    return version
