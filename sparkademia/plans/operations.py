"""Queries of the observer, the gates and the run reports: noise, classification, seeds, page tests, delays, resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkademia.functions import text as X
from sparkademia.functions import urls as U
from sparkademia.operators import accesslog, frontier, relational, search, transform
from sparkademia.plans.analytics import _LOG, _events_run, _q
from sparkademia.plans.registry import Registry
from sparkademia.session import table

R = Registry()

_any = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_host = lambda u: f"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1))"


@R.query("""
    WITH f AS (SELECT run_id, queued_at, (CASE WHEN status = 'error' THEN 5 ELSE 0 END + CASE WHEN depth > 5 THEN 2 ELSE 0 END + CASE WHEN retry_count > 0 THEN 1 ELSE 0 END) AS score,
                      concat_ws('; ', CASE WHEN status = 'error' THEN 'failed' END, CASE WHEN depth > 5 THEN 'deep' END, CASE WHEN retry_count > 0 THEN 'retried' END) AS reasons FROM crawl_queue_state)
    SELECT run_id, reasons, count(*) AS candidates, min(queued_at) AS oldest, max(queued_at) AS latest FROM f WHERE score >= 2 GROUP BY run_id, reasons""")
def noise_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose flags weigh two or more, per run and combination of flags."""
    flags = [("failed", F.col("status") == "error", 5), ("deep", F.col("depth") > 5, 2), ("retried", F.col("retry_count") > 0, 1)]
    score, reasons = X.weighted_flags(flags)
    rows = _q(spark, d).select("run_id", "queued_at", score.alias("score"), reasons.alias("reasons")).where("score >= 2")
    out = rows.groupBy("run_id", "reasons").agg(F.count(F.lit(1)).alias("candidates"), F.min("queued_at").alias("oldest"), F.max("queued_at").alias("latest"))
    return out.orderBy(F.desc("run_id"), F.desc("candidates"), "reasons")


@R.query(r"""
    SELECT p.id, coalesce(CASE WHEN u.id IS NULL THEN NULL WHEN regexp_matches(u.url, '(?i)://(www\.)?(courses|apply)\.') THEN 'portal' WHEN regexp_matches(p.program_name, '(?i)\b(studies|analytics)\b') THEN 'broad'
        WHEN NOT regexp_matches(p.program_name, '(?i)(bachelor|master|bsc|msc|ba|ma|phd|学士|修士|博士)') THEN 'needs_review' END, p.excluded_reason) AS excluded_reason
    FROM degree_programs p LEFT JOIN universities u ON u.id = p.university_id""")
def classified_programs(spark: SparkSession, d: str) -> DataFrame:
    """Programmes classified by ordered rules over their names and their university's address; the rules are parameters."""
    name = F.col("program_name")
    rules = [
        ("portal", F.col("university_url").rlike(r"(?i)://(www\.)?(courses|apply)\.")), ("broad", name.rlike(r"(?i)\b(studies|analytics)\b")),
        ("needs_review", ~name.rlike("(?i)(bachelor|master|bsc|msc|ba|ma|phd|学士|修士|博士)")),
    ]
    return transform.classify(table(spark, d, "degree_programs"), table(spark, d, "universities"), rules).select("id", "excluded_reason")


@R.query("SELECT id, url FROM universities WHERE id % 3 = 1 ORDER BY id")
def enabled_seeds(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "universities").select("id", "url", F.when(F.col("id") % 3 == 1, 1).otherwise(0).alias("enabled"))
    return frontier.enabled(u).select("id", "url")


@R.query("SELECT id FROM crawl_queue_state WHERE status = 'done' AND depth = 1")
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    """Conditions that hold only where their parameter is given."""
    return search.given(_q(spark, d), {"run_id": None, "status": "done", "depth": 1}).select("id")


_SITES = """s AS (SELECT min(id) AS id, 'https://' || domain AS source_url, CASE WHEN count(*) FILTER (status = 'done') > 0 THEN ['https://' || domain] ELSE [] END AS roots
    FROM crawl_queue_state WHERE domain IS NOT NULL GROUP BY run_id, domain)"""


def _sites(spark: SparkSession, d: str) -> DataFrame:
    root = F.concat(F.lit("https://"), F.col("domain"))
    g = _q(spark, d).where("domain IS NOT NULL").groupBy("run_id", "domain").agg(F.min("id").alias("id"), F.count_if(F.col("status") == "done").alias("n"))
    none = F.array().cast("array<string>")
    return g.select("id", root.alias("source_url"), F.when(F.col("n") > 0, F.array(root)).otherwise(none).alias("roots"), none.alias("details"))


@R.query(rf"""
    WITH {_SITES}, k AS (SELECT DISTINCT 'https://' || {_host("url")} AS root FROM universities WHERE id % 2 = 0)
    SELECT source_url, max(id) AS id, 1 AS cached_roots FROM s WHERE len(roots) > 0 AND source_url IN (SELECT root FROM k) GROUP BY source_url""")
def cached_results(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose newest result with any seeds has only known ones, so that they needn't be searched again."""
    known = table(spark, d, "universities").where("id % 2 = 0").select(F.concat(F.lit("https://"), U.netloc(F.col("url"))).alias("root"))
    return frontier.cached(_sites(spark, d), known).select("source_url", "id", F.size("roots").alias("cached_roots"))


@R.query(rf"""
    WITH h AS (SELECT lang, doc_id, url, regexp_extract(url, '^[a-z]+', 0) || '://' || {_host("url").replace("lower(", "(", 1)} AS root, contains(lower(url), 'course') AS listed, {_host("url")} AS host FROM documents WHERE url IS NOT NULL),
    k AS (SELECT DISTINCT {_host("url")} AS host FROM universities WHERE id % 2 = 0), o AS (SELECT h.*, h.host IN (SELECT host FROM k) AS known FROM h),
    f AS (SELECT lang, root, min(doc_id) AS place, bool_or(known) AS known FROM o GROUP BY lang, root)
    SELECT lang AS request, (SELECT coalesce(list(root ORDER BY place), []) FROM f WHERE f.lang IS NOT DISTINCT FROM o.lang AND NOT f.known) AS roots,
           count(*) FILTER (listed AND NOT known) AS details, bool_or(listed) AS listed, CASE WHEN bool_or(listed) THEN 1 ELSE 2 END AS depth,
           (SELECT coalesce(list(root ORDER BY root), []) FROM f WHERE f.lang IS NOT DISTINCT FROM o.lang AND f.known) AS known FROM o GROUP BY lang""")
def assembled_results(spark: SparkSession, d: str) -> DataFrame:
    """Search hits of each request made into its result: new and known start urls, listing pages, depth."""
    hits = table(spark, d, "documents").where("url IS NOT NULL").select(F.col("lang").alias("request"), F.col("doc_id").alias("place"), "url", F.lower("url").contains("course").alias("course_like"))
    u = table(spark, d, "universities").where("id % 2 = 0").select(U.netloc(F.col("url")).alias("host"))
    known = u.select(F.explode(F.array(F.concat(F.lit("https://"), F.col("host")), F.concat(F.lit("http://"), F.col("host")))).alias("root"))
    return frontier.assemble(hits, known).select("request", "roots", F.size("details").alias("details"), "listed", "depth", "known")


@R.query(rf"""
    WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
    SELECT doc_id, CASE WHEN {_any("t", X.BOT_MARKERS)} THEN 'BLOCKED' WHEN contains(t, 'enable javascript') THEN 'JS_ONLY' WHEN length(t) < 900 THEN 'EMPTY' WHEN {_any("t", X.COURSE_HINTS)} THEN 'OK' ELSE 'EMPTY' END AS class FROM t""")
def site_classes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page can be used: blocked, script only, empty or fine."""
    return table(spark, d, "documents").select("doc_id", X.site_class(F.col("text"), least=900).alias("class"))


@R.query(rf"""
    WITH x AS (SELECT doc_id, lower(coalesce(url, '') || ' ' || coalesce(split_part(text, chr(10), 1), '') || '  ' || coalesce(text, '')) AS t, lower(coalesce(text, '')) AS h,
                      lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)) AS p FROM documents),
    s AS (SELECT doc_id, (contains(h, 'fees') AND {_any("t", ["search", "finder", "filter", "query"])}) AS f,
                 ({" + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in X.COURSE_HINTS)}) >= 2 OR contains(p, '/program') OR contains(p, '/course') AS l FROM x)
    SELECT doc_id, l AS course_list, CASE WHEN l THEN 3.0 ELSE 0.0 END::DOUBLE AS bonus FROM s""")
def page_probes(spark: SparkSession, d: str) -> DataFrame:
    """What a fetched page adds to a search hit's score."""
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    p = table(spark, d, "documents").select("doc_id", X.page_signals(F.col("url"), title, F.lit(""), F.col("text")).alias("s"))
    return p.select("doc_id", "s.course_list", F.col("s.bonus").cast("double").alias("bonus"))


@R.query(r"""
    WITH n AS (SELECT id, trim(name, ' ') AS n, regexp_matches(name, '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]') AS j FROM universities)
    SELECT id, unnest(CASE WHEN n IS NULL OR n = '' THEN [] WHEN j THEN [n || ' 公式', n || ' official'] ELSE [n || ' official', n || ' official site'] END) AS query FROM n""")
def discovery_queries(spark: SparkSession, d: str) -> DataFrame:
    """Two search phrases for each university."""
    u = table(spark, d, "universities").where("name IS NOT NULL")
    return u.select("id", F.explode(X.discovery_queries(F.col("name"), 2)).alias("query"))


@R.query("""
    WITH g AS (SELECT run_id, url, arg_min(fetch_method, id) FILTER (status = 'done' AND fetch_method IS NOT NULL) AS f, arg_max(fetch_method, id) FILTER (fetch_method IS NOT NULL) AS l, bool_or(retry_count >= 3) AS b
               FROM crawl_queue_state WHERE url IS NOT NULL GROUP BY run_id, url)
    SELECT run_id, url, CASE WHEN b THEN 'requests' ELSE coalesce(f, l, 'unknown') END AS method FROM g""")
def fetch_methods(spark: SparkSession, d: str) -> DataFrame:
    """The client that fetched a page, by the log of its attempts."""
    ok = F.coalesce(F.col("status") == "done", F.lit(False))
    known = F.col("fetch_method").isNotNull()
    g = _q(spark, d).where("url IS NOT NULL").groupBy("run_id", "url").agg(
        F.min_by("fetch_method", F.when(known & ok, F.col("id"))).alias("first"), F.max_by("fetch_method", F.when(known, F.col("id"))).alias("last"),
        F.coalesce(F.bool_or(F.col("retry_count") >= 3), F.lit(False)).alias("fallback"),
    )
    # the first that succeeded and the last that tried stand for the whole log
    entry = lambda c, ok: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("client"), F.lit(ok).alias("ok")))
    return g.select("run_id", "url", X.fetch_method(F.array_compact(F.array(entry("first", True), entry("last", False))), F.col("fallback")).alias("method"))


@R.query(rf"""
    WITH c AS (SELECT run_id, parent_url, child_url, min(id) AS id FROM crawl_edges WHERE {_any("lower(child_url)", U.SITEMAP_WORDS)} GROUP BY ALL)
    SELECT run_id, parent_url, list(child_url ORDER BY id)[1:3] AS urls FROM c GROUP BY run_id, parent_url""")
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """Of each page's links the first three different ones with a telling word."""
    telling = U.any_of([F.lower("child_url").contains(w) for w in U.SITEMAP_WORDS])
    links = table(spark, d, "crawl_edges").where(telling).groupBy("run_id", "parent_url", "child_url").agg(F.min("id").alias("id"))
    first = relational.top_per_group(links, ["run_id", "parent_url"], [F.col("id")], 3)
    urls = F.transform(F.sort_array(F.collect_list(F.struct("id", "child_url"))), lambda x: x["child_url"])
    return first.groupBy("run_id", "parent_url").agg(U.priority_urls(urls, 3).alias("urls"))


@R.query("""
    SELECT id, coalesce(contains(lower(last_error_message), 'timeout') OR contains(lower(last_error_message), 'refused'), false) AS fatal,
           coalesce(lower(trim(status, ' ')) IN ('1', 'true', 't', 'yes', 'y'), false) AS flag FROM crawl_queue_state""")
def fatal_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose errors name something fatal, and a text read as yes or no."""
    errors = F.array_compact(F.array("last_error_message"))
    return _q(spark, d).select("id", X.has_fatal(errors, ["Timeout", "refused"]).alias("fatal"), X.parse_bool(F.col("status")).alias("flag"))


@R.query("""
    SELECT id, CASE WHEN timestamp IS NULL OR lower(trim(timestamp, ' ')) IN ('', 'none', 'null', 'nan', 'n/a', 'na', '-') THEN NULL ELSE try_cast(timestamp AS TIMESTAMPTZ) END AS at
    FROM resource_samples WHERE timestamp LIKE '____-__-__T%' OR timestamp IN ('', 'n/a')""")
def tolerant_timestamps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "resource_samples").where("timestamp LIKE '____-__-__T%' OR timestamp IN ('', 'n/a')")
    return rows.select("id", X.parse_timestamp(F.col("timestamp")).alias("at"))


@R.query(rf"""
    WITH {_LOG}, x AS (SELECT *, lag(path) OVER w AS pp, lag(t) OVER w AS pt FROM r WINDOW w AS (PARTITION BY host ORDER BY t, line)),
         a AS (SELECT *, t - lag(t) OVER (PARTITION BY host ORDER BY t, line) AS gap FROM x WHERE pp IS NULL OR pp <> path),
         g AS (SELECT host, count(gap) AS pairs, min(gap) AS least, count(*) FILTER (gap < 59.95) AS short, substr(host, 2)::INT % 5 <> 0 AS use FROM a GROUP BY host),
         p AS (SELECT count(*) FILTER (pp = path) AS n FROM x)
    SELECT count(*) FILTER (use AND pairs > 0) AS domains_checked, (SELECT count(*) FROM range(50) t(i) WHERE i % 5 = 0) AS domains_excluded, coalesce(sum(short) FILTER (use AND pairs > 0), 0)::BIGINT AS violations,
           count(*) FILTER (use AND pairs > 0 AND short > 0) AS domains_with_violations, round(min(least) FILTER (use AND pairs > 0) - 60, 5) AS min_margin_sec, (SELECT n FROM p)::BIGINT AS retry_pairs FROM g""")
def log_delay_summary(spark: SparkSession, d: str) -> DataFrame:
    """How well delays were kept over all hosts."""
    s = accesslog.crawl_delay_summary(accesslog.crawl_delay(_events_run(spark, d)))
    return s.withColumn("min_margin_sec", F.round("min_margin_sec", 5))


@R.query(rf"""
    WITH {_LOG}, x AS (SELECT *, lag(path) OVER w AS pp FROM r WINDOW w AS (PARTITION BY host ORDER BY t, line)),
         a AS (SELECT *, t - lag(t) OVER (PARTITION BY host ORDER BY t, line) AS gap FROM x WHERE pp IS NULL OR pp <> path),
         g AS (SELECT host, count(gap) AS pairs, min(gap) AS least, count(*) FILTER (gap < 59.95) AS short FROM a GROUP BY host),
         p AS (SELECT host, count(*) FILTER (pp = path) AS n FROM x GROUP BY host), h AS (SELECT 'h' || i AS host, CASE WHEN i % 5 <> 0 THEN 60.0 END AS delay FROM range(50) t(i))
    SELECT delay AS required_delay, count(*) AS domains, round(min(least) FILTER (pairs > 0), 5) AS min_interval, sum(CASE WHEN delay IS NOT NULL AND pairs > 0 THEN short END)::BIGINT AS violations, coalesce(sum(p.n), 0)::BIGINT AS retry_pairs
    FROM h LEFT JOIN g USING (host) LEFT JOIN p USING (host) GROUP BY delay""")
def log_delay_table(spark: SparkSession, d: str) -> DataFrame:
    """The same per required delay, hosts without one last."""
    t = accesslog.crawl_delay_table(accesslog.crawl_delay(_events_run(spark, d)))
    return t.withColumn("min_interval", F.round("min_interval", 5)).withColumn("retry_pairs", F.coalesce("retry_pairs", F.lit(0)))


_USAGE = """u AS (SELECT worker_id AS source, count(*) AS samples, avg(system_cpu_percent) AS cpu_avg, max(system_cpu_percent) AS cpu_max, avg(process_cpu_percent) AS process_cpu_avg,
    max(process_cpu_percent) AS process_cpu_max, max(process_rss_mb) AS rss_max, max(system_memory_percent) AS memory_max FROM resource_samples WHERE elapsed_sec BETWEEN 595 AND 5005 GROUP BY worker_id)"""


def _usage(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "resource_samples").withColumn("source", F.col("worker_id")).withColumn("at", F.timestamp_seconds("elapsed_sec"))
    return accesslog.resource_usage(s, 600.0, 5000.0)


@R.query(f"WITH {_USAGE} SELECT source, samples, round(cpu_avg, 6) AS cpu_avg, cpu_max, round(process_cpu_avg, 6) AS process_cpu_avg, process_cpu_max, rss_max, memory_max FROM u")
def log_resources(spark: SparkSession, d: str) -> DataFrame:
    """Load of each worker within a run's time."""
    return _usage(spark, d).withColumn("cpu_avg", F.round("cpu_avg", 6)).withColumn("process_cpu_avg", F.round("process_cpu_avg", 6))


@R.query(f"WITH {_USAGE} SELECT round(avg(cpu_avg), 6) AS cpu_avg, max(cpu_max) AS cpu_max, max(rss_max) AS rss_max, round(avg(process_cpu_avg), 6) AS process_cpu_avg, max(process_cpu_max) AS process_cpu_max FROM u")
def log_resource_totals(spark: SparkSession, d: str) -> DataFrame:
    t = accesslog.resource_totals(_usage(spark, d))
    return t.withColumn("cpu_avg", F.round("cpu_avg", 6)).withColumn("process_cpu_avg", F.round("process_cpu_avg", 6))


@R.query("""
    WITH p AS (SELECT DISTINCT 'h' || (user_id % 50) AS host, '/' || event_type || '-' || (user_id % 7) AS path, event_type = 'error' AS e FROM events)
    SELECT 'events-run1' AS label, count(*) FILTER (e) || ' URLs failed unexpectedly' AS warning FROM p HAVING count(*) FILTER (e) > 0""")
def log_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What makes a run doubtful; the delays aren't looked at here."""
    return accesslog.warnings(accesslog.run_metrics(_events_run(spark, d)).withColumn("violations", F.lit(0)).withColumn("overhead_p95", F.lit(0.0)))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.oracles
