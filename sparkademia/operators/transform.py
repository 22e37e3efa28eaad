"""Nested page records to four related tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkademia.functions import text as X
from sparkademia.functions import urls as U
from sparkademia.operators.relational import with_row_numbers


PATTERN_KEY = (
    "degree_level", "amount", "currency", "fee_type", "tuition_type", "amount_min", "amount_max", "normalized_monthly_amount", "normalization_note",
)


def quality_flag(course_type: Column, price: Column, currency: Column) -> Column:
    """low where the subject is general or price or currency are missing."""
    lacking = price.isNull() | currency.isNull() | (currency == "")
    return F.when((course_type == "general") | lacking, F.lit("low")).otherwise(F.lit("high"))


def explode_degrees(records: DataFrame) -> DataFrame:
    """One row per degree of each page with its place (record `ordinal`, degree `pos`); a page without degrees gives one
    general row without a price. Fields that a degree lacks get their defaults."""
    some = F.col("degrees").isNotNull() & (F.size("degrees") > 0)
    rows = records.select(
        "ordinal", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), "country", "timestamp",
        F.posexplode_outer(F.when(some, F.col("degrees"))).alias("pos", "d"),
    )
    d = lambda n: F.col("d").getField(n)
    name = X.program_name(F.col("title"))
    return rows.select(
        "ordinal", F.coalesce("pos", F.lit(0)).alias("pos"), "url", "country", "timestamp", U.university_name(F.col("url")).alias("university"), name.alias("program_name"),
        F.coalesce(d("course_type"), F.lit("general")).alias("course_type"), F.coalesce(d("is_online"), F.lit(False)).alias("is_online"),
        F.when(F.col("d").isNull(), name).otherwise(d("name")).alias("degree"), d("price").alias("amount"), d("currency").alias("currency"), F.lit("tuition").alias("fee_type"),
        F.coalesce(d("tuition_type"), F.lit("unknown")).alias("tuition_type"), d("amount_min").alias("amount_min"), d("amount_max").alias("amount_max"),
        d("normalized_monthly_amount").alias("normalized_monthly_amount"), F.coalesce(d("normalization_note"), F.lit("unknown_not_normalized")).alias("normalization_note"),
    ).withColumn("degree_level", X.degree_level(F.col("degree")))


class Transform:
    """The four tables of some page records; each is computed when it is asked for, from rows that are numbered once.

    records: page records with a unique `ordinal` that gives their order. Universities and patterns get ids in the order in
    which they are first met, programmes in the order of pages and degrees. A university's url and country are those of its
    first page. Programmes without price or currency have no pattern. Null and empty degree lists are alike; an empty table
    gives four empty tables.
    """

    def __init__(self, records: DataFrame):
        self.rows = with_row_numbers(explode_degrees(records), ["ordinal", "pos"], "id")

    @cached_property
    def universities(self) -> DataFrame:
        first = self.rows.groupBy("university").agg(F.min(F.struct("id", "url", "country")).alias("f")).select("university", F.col("f.id").alias("at"), "f.url", "f.country")
        return with_row_numbers(first, ["at"], "id").select("id", F.col("university").alias("name"), "country", "url")

    @cached_property
    def degree_programs(self) -> DataFrame:
        ids = self.universities.select(F.col("id").alias("university_id"), F.col("name").alias("university"))
        return self.rows.join(ids, "university").select(
            "id", "university_id", "program_name", "course_type", "is_online", F.col("url").alias("source_url"), X.wall_clock(F.col("timestamp")).alias("last_seen"),
            quality_flag(F.col("course_type"), F.col("amount"), F.col("currency")).alias("quality_flag"),
        )

    @cached_property
    def _priced(self) -> DataFrame:
        return self.rows.where(F.col("amount").isNotNull() & F.col("currency").isNotNull() & (F.col("currency") != ""))

    @cached_property
    def tuition_patterns(self) -> DataFrame:
        distinct = self._priced.groupBy(*PATTERN_KEY).agg(F.min("id").alias("at"))
        return with_row_numbers(distinct, ["at"], "id").select("id", *PATTERN_KEY)

    @cached_property
    def program_tuition_map(self) -> DataFrame:
        priced, patterns = self._priced, self.tuition_patterns
        same = [priced[k].eqNullSafe(patterns[k]) for k in PATTERN_KEY]
        return priced.join(patterns, same).select(priced["id"].alias("degree_program_id"), patterns["id"].alias("tuition_pattern_id"))


transform = Transform


def merge_records(records: DataFrame) -> DataFrame:
    """Pages with one canonical url and title made one: their degrees in order without repeats, the longest text, the
    first title that isn't empty."""
    key = [U.canonical(F.coalesce("url", F.lit(""))).alias("__u"), F.lower(F.trim(F.coalesce("title", F.lit("")))).alias("__t")]
    order = F.struct("ordinal", "url", "title", "country", "timestamp")
    g = records.groupBy(*key).agg(F.min(order).alias("f"), F.max_by("raw_text", F.struct(F.length("raw_text"), -F.col("ordinal"))).alias("raw_text"))
    degrees = records.select(*key, "ordinal", F.posexplode("degrees").alias("pos", "d"))
    first = degrees.groupBy("__u", "__t", degree_key(F.col("d")).alias("k")).agg(F.min(F.struct("ordinal", "pos", "d")).alias("x"))
    lists = first.groupBy("__u", "__t").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["d"]).alias("degrees"))
    none = F.array().cast(records.schema["degrees"].dataType)
    out = g.alias("g").join(lists.alias("l"), ["__u", "__t"], "left")
    return out.select("f.ordinal", "f.url", "f.title", "f.country", "f.timestamp", F.coalesce("degrees", none).alias("degrees"), "raw_text")


def repeated_degrees(records: DataFrame) -> DataFrame:
    """One row: degrees of all pages, different ones, those that come more than once, and how many those are in all."""
    g = records.select(F.explode("degrees").alias("d")).groupBy(degree_key(F.col("d")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    more = F.col("n") > 1
    return g.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique_groups"), F.count_if(more).alias("repeated_groups"),
        F.coalesce(F.sum(F.when(more, F.col("n"))), F.lit(0)).alias("repeated_items"),
    )


def classify(rows: DataFrame, universities: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "excluded_reason") -> DataFrame:
    """`rows` with `name` set to the first rule that holds, in order; where none does, the old value stays. rules: (reason,
    condition) over the rows' columns and university_url. Rows without a university keep their value, whatever the rules."""
    u = universities.select(F.col("id").alias("__u"), F.col("url").alias("university_url"))
    reason = F.lit(None).cast("string")
    for value, holds in reversed(list(rules)):
        reason = F.when(holds, F.lit(value)).otherwise(reason)
    joined = rows.join(u, rows["university_id"] == F.col("__u"), "left")
    return joined.withColumn(name, F.coalesce(F.when(F.col("__u").isNotNull(), reason), F.col(name))).drop("__u", "university_url")


def degree_key(d: Column) -> Column:
    low = lambda n: F.lower(F.trim(F.coalesce(d[n], F.lit(""))))
    subject = F.when(F.coalesce(d["course_type"], F.lit("")) == "", F.lit("general")).otherwise(F.lower(F.trim(d["course_type"])))
    return F.struct(low("context").alias("a"), low("name").alias("b"), d["price"].alias("c"), F.upper(F.trim(F.coalesce(d["currency"], F.lit("")))).alias("e"), subject.alias("f"))
