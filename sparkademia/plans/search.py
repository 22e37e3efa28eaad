"""Search queries: every filter, sort order, page, count, facet and detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkademia.operators import search as S
from sparkademia.plans.registry import Registry
from sparkademia.session import table

R = Registry()


def tables(spark: SparkSession, d: str) -> S.Tables:
    return S.Tables(*(table(spark, d, n) for n in ("degree_programs", "universities", "tuition_patterns", "program_tuition_map")))


_SELECT = """
    SELECT dp.id, dp.program_name, u.country, u.name AS university_name, tp.degree_level, dp.course_type, tp.amount,
           tp.currency, tp.tuition_type, tp.normalized_monthly_amount, tp.normalization_note, dp.is_online, dp.last_seen,
           dp.source_url
    FROM degree_programs dp JOIN universities u ON dp.university_id = u.id
    LEFT JOIN program_tuition_map m ON m.degree_program_id = dp.id
    LEFT JOIN tuition_patterns tp ON m.tuition_pattern_id = tp.id
    WHERE (dp.excluded_reason IS NULL OR dp.excluded_reason = 'needs_review')"""


def _sql(condition: str, sort: str = "dp.last_seen DESC", limit: int = 20, offset: int = 0) -> str:
    return f"{_SELECT} {condition} ORDER BY {sort} NULLS LAST, dp.id, tp.id NULLS LAST LIMIT {limit} OFFSET {offset}"


_KEYWORD = "(dp.program_name ILIKE '%{0}%' OR coalesce(tp.degree_level, '') ILIKE '%{0}%' OR dp.course_type ILIKE '%{0}%')"
_FIXED = "('fixed_year', 'fixed_month', 'fixed_semester')"

#: name -> (parameters, the condition in SQL, sort in SQL)
SEARCHES = {
    "search_default": ({}, "", "dp.last_seen DESC"),
    "search_keyword": ({"keyword": "engineering"}, "AND " + _KEYWORD.format("engineering"), "dp.last_seen DESC"),
    "search_keyword_wildcards": ({"keyword": "a%_science"}, "AND " + _KEYWORD.format("a%_science"), "dp.last_seen DESC"),
    "search_country": ({"country": "UK"}, "AND u.country = 'UK'", "dp.last_seen DESC"),
    "search_degree": ({"degree": "Master"}, "AND tp.degree_level = 'Master'", "dp.last_seen DESC"),
    "search_category": ({"category": "business"}, "AND dp.course_type = 'business'", "dp.last_seen DESC"),
    "search_online": ({"is_online": True}, "AND dp.is_online", "dp.last_seen DESC"),
    "search_offline": ({"is_online": False, "sort_order": "asc"}, "AND NOT dp.is_online", "dp.last_seen ASC"),
    "search_tuition_type": ({"tuition_type": "range"}, "AND tp.tuition_type = 'range'", "dp.last_seen DESC"),
    "search_fixed_only": ({"fixed_only": True, "limit": 100}, f"AND tp.tuition_type IN {_FIXED}", "dp.last_seen DESC"),
    "search_non_fixed_only": ({"non_fixed_only": True}, f"AND tp.tuition_type NOT IN {_FIXED}", "dp.last_seen DESC"),
    "search_currency": ({"currency": "EUR"}, "AND tp.currency = 'EUR'", "dp.last_seen DESC"),
    "search_price_range": (
        {"price_min": 1000, "price_max": 20000, "sort_by": "amount", "sort_order": "asc"},
        "AND tp.amount >= 1000 AND tp.amount <= 20000",
        "tp.amount ASC",
    ),
    "search_by_amount_desc": ({"sort_by": "amount"}, "", "tp.amount DESC"),
    "search_by_monthly": (
        {"sort_by": "normalized_monthly_amount", "sort_order": "asc"},
        "",
        "tp.normalized_monthly_amount ASC",
    ),
    "search_page_3": ({"limit": 50, "offset": 100}, "", "dp.last_seen DESC"),
    "search_combined": (
        {"keyword": "master", "country": "UK", "fixed_only": True, "price_min": 500, "sort_by": "amount"},
        f"AND {_KEYWORD.format('master')} AND u.country = 'UK' AND tp.tuition_type IN {_FIXED} AND tp.amount >= 500",
        "tp.amount DESC",
    ),
}

for _name, (_args, _condition, _sort) in SEARCHES.items():
    _p = S.SearchParams(**_args)
    R.add(_name, lambda spark, d, p=_p: S.search(tables(spark, d), p), _sql(_condition, _sort, _p.limit, _p.offset))
    if _name in ("search_default", "search_keyword", "search_non_fixed_only", "search_combined"):
        R.add(
            _name.replace("search", "search_total"),
            lambda spark, d, p=_p: S.count(tables(spark, d), p),
            f"SELECT count(DISTINCT id) AS total FROM ({_SELECT} {_condition})",
        )


@R.query("""
    SELECT dp.id, dp.program_name, dp.course_type, dp.is_online, dp.source_url, dp.last_seen, u.name AS university_name,
           u.country
    FROM degree_programs dp JOIN universities u ON dp.university_id = u.id
    WHERE dp.id = 7 AND (dp.excluded_reason IS NULL OR dp.excluded_reason = 'needs_review')""")
def program_detail(spark: SparkSession, d: str) -> DataFrame:
    return S.detail(tables(spark, d), 7)


@R.query("""
    SELECT degree_level, amount, currency, tuition_type, normalized_monthly_amount, normalization_note
    FROM tuition_patterns tp JOIN program_tuition_map m ON m.tuition_pattern_id = tp.id
    WHERE m.degree_program_id = 7 ORDER BY tuition_type NULLS LAST, amount NULLS LAST""")
def program_tuition_records(spark: SparkSession, d: str) -> DataFrame:
    return S.tuition_records(tables(spark, d), 7)


@R.query("""
    SELECT DISTINCT u.country FROM universities u JOIN degree_programs dp ON dp.university_id = u.id
    WHERE u.country IS NOT NULL AND (dp.excluded_reason IS NULL OR dp.excluded_reason = 'needs_review')""")
def facet_countries(spark: SparkSession, d: str) -> DataFrame:
    return S.country_facet(tables(spark, d))


for _column in ("degree_level", "currency", "tuition_type"):
    R.add(
        f"facet_{_column}s",
        lambda spark, d, c=_column: S.facet(table(spark, d, "tuition_patterns"), c),
        f"SELECT DISTINCT {_column} FROM tuition_patterns WHERE {_column} IS NOT NULL",
    )


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.oracles
