"""Faceted search over programmes, universities and tuition patterns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIXED_TYPES = ("fixed_year", "fixed_month", "fixed_semester")
SORT_COLUMNS = ("last_seen", "amount", "normalized_monthly_amount")
#: Columns of a search result, in order.
COLUMNS = (
    "id", "program_name", "country", "university_name", "degree_level", "course_type", "amount", "currency",
    "tuition_type", "normalized_monthly_amount", "normalization_note", "is_online", "last_seen", "source_url",
)


@dataclass(frozen=True)
class Tables:
    programs: DataFrame
    universities: DataFrame
    patterns: DataFrame
    program_map: DataFrame


@dataclass(frozen=True)
class SearchParams:
    """What a search may be asked. Texts are applied when not empty, is_online when not None, prices when not None."""

    keyword: str | None = None
    country: str | None = None
    degree: str | None = None
    category: str | None = None
    is_online: bool | None = None
    tuition_type: str | None = None
    fixed_only: bool = False
    non_fixed_only: bool = False
    price_min: int | None = None
    price_max: int | None = None
    currency: str | None = None
    sort_by: str = "last_seen"
    sort_order: str = "desc"
    limit: int = 20
    offset: int = 0

    def __post_init__(self) -> None:
        if self.fixed_only and self.non_fixed_only:
            raise ValueError("fixed_only and non_fixed_only exclude each other")
        for p in (self.price_min, self.price_max):
            if p is not None and p < 0:
                raise ValueError("prices must not be negative")
        if self.price_min is not None and self.price_max is not None and self.price_min > self.price_max:
            raise ValueError("price_min must not exceed price_max")
        if self.sort_by not in SORT_COLUMNS:
            raise ValueError(f"sort_by must be one of {SORT_COLUMNS}")
        if self.sort_order not in ("asc", "desc"):
            raise ValueError("sort_order must be asc or desc")
        if not 1 <= self.limit <= 100 or self.offset < 0:
            raise ValueError("limit must be 1 to 100, offset 0 or more")


def visible() -> Column:
    """Programmes that aren't excluded, or are excluded only until someone has looked at them."""
    return F.col("excluded_reason").isNull() | (F.col("excluded_reason") == "needs_review")


def joined(t: Tables) -> DataFrame:
    """A row per visible programme and tuition pattern; programmes without a pattern have one row."""
    dp = t.programs.where(visible()).select("id", "university_id", "program_name", "course_type", "is_online", "last_seen", "source_url")
    u = t.universities.select(F.col("id").alias("university_id"), "country", F.col("name").alias("university_name"))
    m = t.program_map.select(F.col("degree_program_id").alias("id"), F.col("tuition_pattern_id").alias("pattern_id"))
    tp = t.patterns.select(
        F.col("id").alias("pattern_id"), "degree_level", "amount", "currency", "tuition_type", "normalized_monthly_amount", "normalization_note"
    )
    return dp.join(u, "university_id").join(m, "id", "left").join(tp, "pattern_id", "left")


def filtered(t: Tables, p: SearchParams) -> DataFrame:
    rows = joined(t)
    if p.keyword:
        like = f"%{p.keyword}%"
        level = F.coalesce("degree_level", F.lit(""))
        rows = rows.where(F.col("program_name").ilike(like) | level.ilike(like) | F.col("course_type").ilike(like))
    for column, value in (
        ("country", p.country), ("degree_level", p.degree), ("course_type", p.category), ("tuition_type", p.tuition_type), ("currency", p.currency),
    ):
        if value:
            rows = rows.where(F.col(column) == value)
    if p.is_online is not None:
        rows = rows.where(F.col("is_online") == p.is_online)
    if p.fixed_only:
        rows = rows.where(F.col("tuition_type").isin(*FIXED_TYPES))
    if p.non_fixed_only:
        rows = rows.where(~F.col("tuition_type").isin(*FIXED_TYPES))
    if p.price_min is not None:
        rows = rows.where(F.col("amount") >= p.price_min)
    if p.price_max is not None:
        rows = rows.where(F.col("amount") <= p.price_max)
    return rows


def _first(t: Tables, p: SearchParams, order: Column) -> Tables:
    """The tables with the first programmes only, where nothing of a pattern decides: each programme gives a row or more, so
    a page's rows come from as many programmes as it ends at."""
    of_patterns = (p.keyword, p.degree, p.tuition_type, p.currency, p.fixed_only, p.non_fixed_only, p.price_min is not None, p.price_max is not None)
    if p.sort_by != "last_seen" or any(of_patterns):
        return t
    u = t.universities.where(F.col("country") == p.country) if p.country else t.universities
    some = t.programs.where(visible()).join(u.select(F.col("id").alias("university_id")), "university_id", "left_semi")
    if p.category:
        some = some.where(F.col("course_type") == p.category)
    if p.is_online is not None:
        some = some.where(F.col("is_online") == p.is_online)
    return replace(t, programs=some.orderBy(order, "id").limit(p.offset + p.limit))


def search(t: Tables, p: SearchParams = SearchParams()) -> DataFrame:
    """One page of results. Nulls sort last in either direction; ties go by programme and pattern."""
    key = F.col(p.sort_by)
    order = key.asc_nulls_last() if p.sort_order == "asc" else key.desc_nulls_last()
    return filtered(_first(t, p, order), p).orderBy(order, "id", F.col("pattern_id").asc_nulls_last()).offset(p.offset).limit(p.limit).select(*COLUMNS)


def count(t: Tables, p: SearchParams = SearchParams()) -> DataFrame:
    """How many programmes a search finds, whatever the page."""
    return filtered(t, p).agg(F.countDistinct("id").alias("total"))


def detail(t: Tables, program_id: int) -> DataFrame:
    """One visible programme; no row if there is none."""
    u = t.universities.select(F.col("id").alias("university_id"), F.col("name").alias("university_name"), "country")
    return t.programs.where((F.col("id") == program_id) & visible()).join(u, "university_id").select(
        "id", "program_name", "course_type", "is_online", "source_url", "last_seen", "university_name", "country"
    )


def tuition_records(t: Tables, program_id: int) -> DataFrame:
    m = t.program_map.where(F.col("degree_program_id") == program_id).select(F.col("tuition_pattern_id").alias("id"))
    columns = ("degree_level", "amount", "currency", "tuition_type", "normalized_monthly_amount", "normalization_note")
    order = (F.col("tuition_type").asc_nulls_last(), F.col("amount").asc_nulls_last(), "id")
    return t.patterns.join(m, "id").orderBy(*order).select(*columns)


def facet(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column without null, in order."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def country_facet(t: Tables) -> DataFrame:
    """Countries of universities with a visible programme."""
    some = t.programs.where(visible()).select(F.col("university_id").alias("id"))
    return facet(t.universities.join(some, "id", "left_semi"), "country")


def given(df: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """The rows that agree with each value that is given; a value of None sets no condition."""
    for name, value in conditions.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df
