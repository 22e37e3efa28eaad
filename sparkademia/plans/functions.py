"""Queries of the URL and text expressions over the tables, with the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkademia.functions import text as X
from sparkademia.functions import urls as U
from sparkademia.plans.registry import Registry
from sparkademia.session import table

R = Registry()

_HOST = r"lower(regexp_extract(source_url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1))"


@R.query(rf"""
    SELECT id, {_HOST} AS host,
           lower(split_part(regexp_replace(coalesce(source_url, ''), '^[a-zA-Z]+://', ''), '/', 1)) AS domain,
           regexp_replace(lower(split_part(regexp_replace(coalesce(source_url, ''), '^[a-zA-Z]+://', ''), '/', 1)), '^www\.', '') AS bare_domain,
           split_part(split_part(source_url, '//', 2), '/', 1) AS logged_domain,
           CASE WHEN {_HOST} LIKE '%.uk' THEN 'UK' WHEN {_HOST} LIKE '%.edu' OR {_HOST} LIKE '%.gov' THEN 'US'
                WHEN {_HOST} LIKE '%.jp' THEN 'JP' ELSE 'unknown' END AS country
    FROM degree_programs""")
def url_domains(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("source_url")
    return table(spark, d, "degree_programs").select(
        "id", U.netloc(u).alias("host"), U.domain(u).alias("domain"), U.without_www(U.domain(u)).alias("bare_domain"),
        U.logged_domain(u).alias("logged_domain"), U.country(u).alias("country"),
    )


@R.query(r"""
    SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(source_url, '^\s+|\s+$', '', 'g')), '(?s)#.*', ''), '(?s)\?.*', ''),
               '/20\d{2}/', '/', 'g'), '/+$', '') AS canonical, 'seen:' || sha1(source_url) AS seen_key
    FROM degree_programs""")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("source_url")
    return table(spark, d, "degree_programs").select("id", U.canonical(u).alias("canonical"), U.seen_key(u).alias("seen_key"))


_BARE = "regexp_extract(lower(url), '^([^?#]*)', 1)"
_EXT = "(" + " OR ".join(f"{_BARE} LIKE '%{e}'" for e in U.NON_HTML_EXTENSIONS) + ")"
_BAD = "(" + " OR ".join(f"contains({_BARE}, '{w}')" for w in U.BAD_PARTS) + ")"


@R.query(f"SELECT id, {_EXT} AS non_html, ({_EXT} OR {_BAD}) AS filtered FROM crawl_queue_state")
def url_filters(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "crawl_queue_state").select("id", U.is_non_html(u).alias("non_html"), U.is_filtered(u).alias("filtered"))


_AUTH = r"regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"
_PATH = r"regexp_replace(regexp_extract(regexp_replace(regexp_replace({0}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', ''), '^[A-Za-z][A-Za-z0-9+.\-]*:', ''), '^([^?#]*)', 1), '/+$', '')"


@R.query(f"""
    WITH e AS (SELECT id, {_AUTH.format("parent_url")} AS ha, {_AUTH.format("child_url")} AS hc,
                      CASE WHEN {_PATH.format("parent_url")} = '' THEN '/' ELSE {_PATH.format("parent_url")} END AS s,
                      CASE WHEN {_PATH.format("child_url")} = '' THEN '/' ELSE {_PATH.format("child_url")} END AS p
               FROM crawl_edges)
    SELECT id, (ha = hc AND (s = '/' OR p = s OR starts_with(p, s || '/'))) AS inside FROM e""")
def url_scope(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_edges").select("id", U.in_scope(F.col("child_url"), F.col("parent_url")).alias("inside"))


_MARK = "(" + " OR ".join(f"contains(t, '{m}')" for m in U.EXCLUDED_MARKERS) + ")"


@R.query(f"""
    WITH x AS (SELECT id, lower({_PATH.format("source_url")}) AS p, lower(program_name || ' ' || regexp_extract(regexp_replace(source_url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', ''), '^([^?#]*)', 1)) AS t,
                      lower(regexp_extract(source_url, '^[^?#]*\\?([^#]*)', 1)) AS q FROM degree_programs)
    SELECT id, (contains(q, 'page=') OR list_contains({U.LISTING_PATHS}, p) OR (contains(q, 'query=') AND (contains(p, '/programmes') OR contains(p, '/study/courses'))) OR {_MARK}) AS excluded
    FROM x""")
def url_excluded_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "degree_programs").select("id", U.is_excluded_page(F.col("source_url"), F.col("program_name")).alias("excluded"))


_HIT = "len(regexp_extract_all(lower(text), '{0}'))"


def _hits_sql(name: str) -> str:
    parts = []
    for w in X.COURSE_KEYWORDS[name]:
        latin = any("a" <= ch <= "z" for ch in w)
        parts.append(_HIT.format(rf"\b{w}\b" if latin else w))
    return " + ".join(parts)


_SCORES = ", ".join(f"({_hits_sql(n)}) AS {n}" for n in X.COURSE_KEYWORDS)
_BEST = ", ".join(f"{{'score': 3 * {n}, 'rank': {-X.COURSE_PRIORITY.index(n)}, 'name': '{n}'}}" for n in X.COURSE_KEYWORDS)


@R.query(f"""
    WITH s AS (SELECT id, {_SCORES} FROM (SELECT id, program_name AS text FROM degree_programs)),
         b AS (SELECT id, list_max([{_BEST}]) AS m FROM s)
    SELECT id, CASE WHEN m.score > 0 THEN m.name ELSE 'general' END AS subject FROM b""")
def program_subject(spark: SparkSession, d: str) -> DataFrame:
    """The subject that a programme's name scores highest in."""
    return table(spark, d, "degree_programs").select("id", X.course_type(F.col("program_name")).alias("subject"))


@R.query("""
    WITH p AS (SELECT id, lower(trim(coalesce(program_name, ''), ' ')) AS n, program_name FROM degree_programs)
    SELECT id, trim(split_part(program_name, ' - ', 1), ' ') AS program,
           CASE WHEN contains(n, 'phd') OR contains(n, 'doctorate') OR contains(n, '博士') THEN 'PhD'
                WHEN contains(n, 'bachelor') OR contains(n, 'undergraduate') OR contains(n, 'bsc') OR contains(n, 'beng') OR contains(n, 'ba ') OR contains(n, '学士') THEN 'Bachelor'
                WHEN contains(n, 'master') OR contains(n, 'postgraduate') OR contains(n, 'graduate') OR contains(n, 'msc') OR contains(n, 'meng') OR contains(n, 'ma ') OR contains(n, '修士') THEN 'Master'
                ELSE 'Other' END AS level
    FROM p""")
def program_levels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("program_name")
    return table(spark, d, "degree_programs").select("id", X.program_name(n).alias("program"), X.degree_level(n).alias("level"))


@R.query("""
    WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM
               (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents)),
         c AS (SELECT doc_id, line_no, lower(line) AS low, line FROM l),
         n AS (SELECT *, list_filter(list_transform(regexp_extract_all(line, '([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{4,})'), lambda x: try_cast(replace(x, ',', '') AS BIGINT)), lambda v: NOT (v BETWEEN 2000 AND 2099)) AS v FROM c)
    SELECT doc_id, line_no,
           CASE WHEN regexp_matches(low, '[0-9].{0,10}(-|–|to).{0,10}[0-9]') THEN 'range'
                WHEN contains(low, 'per credit') OR contains(low, '/credit') THEN 'per_credit'
                WHEN contains(low, 'per course') OR contains(low, '/course') THEN 'per_course'
                WHEN contains(low, 'per month') OR contains(low, '/month') OR contains(low, 'monthly') THEN 'fixed_month'
                WHEN contains(low, 'per semester') OR contains(low, '/semester') THEN 'fixed_semester'
                WHEN contains(low, 'per year') OR contains(low, '/year') OR contains(low, 'annual') THEN 'fixed_year'
                WHEN contains(low, 'total') OR contains(low, 'full program') THEN 'total' ELSE 'unknown' END AS fee_type,
           CASE WHEN len(v) >= 2 THEN list_min(v) END AS low_amount, CASE WHEN len(v) >= 2 THEN list_max(v) END AS high_amount
    FROM n WHERE regexp_matches(line, '[0-9]')""")
def fee_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a document with a figure: its fee wording and range of amounts."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("p", "line")).where(F.col("line").rlike("[0-9]"))
    r = X.amount_range(F.col("line"))
    return rows.select("doc_id", (F.col("p") + 1).alias("line_no"), X.fee_class(F.col("line")).getField("tuition_type").alias("fee_type"), r.getField("low").alias("low_amount"), r.getField("high").alias("high_amount"))


@R.query(r"""
    SELECT id, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda t: length(t) >= 3) AS tokens,
           len(list_filter(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda t: length(t) >= 3),
               lambda t: NOT list_contains(['university', 'college', 'institute', 'school'], t)
                    AND contains(lower(split_part(split_part(url, '//', 2), '/', 1)), t))) * 0.8::DOUBLE AS bonus
    FROM universities""")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of a university's name and how well its domain fits them."""
    return table(spark, d, "universities").select(
        "id", X.name_tokens(F.col("name")).alias("tokens"), X.domain_bonus(U.logged_domain(F.col("url")), F.array("name")).alias("bonus")
    )


_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@R.query(rf"""
    WITH x AS (SELECT doc_id, lower({_PATH.format("url")}) AS p, lower({_AUTH.format("url")}) AS h,
                      lower(coalesce(url, '') || ' ' || coalesce(split_part(text, chr(10), 1), '') || ' ') AS t,
                      lower(source) AS q FROM documents)
    SELECT doc_id, (CASE WHEN {_ANY("p", X.COURSE_HINTS)} THEN 4.0 ELSE 0 END + CASE WHEN {_ANY("t", X.COURSE_HINTS)} THEN 2.0 ELSE 0 END
            + CASE WHEN length(q) > 0 AND contains(t, q) THEN 2.0 ELSE 0 END
            + CASE WHEN h LIKE '%.edu' OR h LIKE '%.ac.uk' OR h LIKE '%.ac.jp' OR h LIKE '%.edu.au' THEN 1.5 ELSE 0 END
            + CASE WHEN {_ANY("t", X.CONTRARY_HINTS)} THEN -3.0 ELSE 0 END)::DOUBLE AS score
    FROM x""")
def course_scores(spark: SparkSession, d: str) -> DataFrame:
    """How much each document looks like a page about courses."""
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", X.course_like_score(F.col("url"), title, F.lit(""), F.col("source")).cast("double").alias("score"))


@R.query(r"""
    SELECT id, timestamp AS raw,
           CASE WHEN regexp_matches(timestamp, '^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$')
                     AND try_strptime(replace(timestamp[1:19], 'T', ' '), '%Y-%m-%d %H:%M:%S') IS NOT NULL
                THEN replace(timestamp[1:19], 'T', ' ') ELSE timestamp END AS wall
    FROM resource_samples""")
def wall_clocks(spark: SparkSession, d: str) -> DataFrame:
    """ISO times in their own offset; other texts unchanged."""
    return table(spark, d, "resource_samples").select("id", F.col("timestamp").alias("raw"), X.wall_clock(F.col("timestamp")).alias("wall"))


@R.query("""
    SELECT id, CASE WHEN timestamp IS NULL OR lower(trim(timestamp, ' ')) IN ('', 'none', 'null', 'nan', 'n/a', 'na', '-') THEN NULL
                    ELSE try_cast(timestamp AS DOUBLE) END AS number,
           coalesce(try_cast(trunc(try_cast(timestamp AS DOUBLE)) AS BIGINT), 0) AS whole
    FROM resource_samples""")
def tolerant_numbers(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("timestamp")
    return table(spark, d, "resource_samples").select("id", X.parse_float(t).alias("number"), X.to_int(t).alias("whole"))


@R.query("""
    SELECT id, (CASE WHEN status = 'error' THEN 5 ELSE 0 END + CASE WHEN retry_count > 0 THEN 2 ELSE 0 END
                + CASE WHEN contains(coalesce(last_error_message, ''), 'timeout') THEN 4 ELSE 0 END + CASE WHEN depth > 5 THEN 1 ELSE 0 END) AS score,
           concat_ws('; ', CASE WHEN status = 'error' THEN 'error' END, CASE WHEN retry_count > 0 THEN 'retried' END,
                     CASE WHEN contains(coalesce(last_error_message, ''), 'timeout') THEN 'timeout' END, CASE WHEN depth > 5 THEN 'deep' END) AS reasons
    FROM crawl_queue_state""")
def flag_scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted flags of each queue row, added up, with their names."""
    score, reasons = X.weighted_flags([
        ("error", F.col("status") == "error", 5), ("retried", F.col("retry_count") > 0, 2),
        ("timeout", F.coalesce("last_error_message", F.lit("")).contains("timeout"), 4), ("deep", F.col("depth") > 5, 1),
    ])
    return table(spark, d, "crawl_queue_state").select("id", score.alias("score"), reasons.alias("reasons"))


@R.query(rf"""
    WITH s AS (SELECT id, {_AUTH.format("url")} AS a, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS sc, url FROM crawl_queue_state)
    SELECT id, CASE WHEN a = '' THEN '' ELSE (CASE WHEN sc = '' THEN 'https' ELSE sc END) || '://' || a END AS root,
           (regexp_matches(trim(url, ' '), '(?i)^https?://') AND a <> '' AND NOT contains(a, '*')) AS absolute
    FROM s""")
def url_roots(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "crawl_queue_state").select("id", U.root_url(u).alias("root"), U.is_absolute_http(u).alias("absolute"))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.oracles
