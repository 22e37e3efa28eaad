"""Joins, aggregates, windows, top-k and set operations over the crawl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkademia.functions import html
from sparkademia.functions import urls as U
from sparkademia.operators import accesslog, merge, relational, search
from sparkademia.plans.registry import Registry
from sparkademia.session import table

R = Registry()


def _q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_queue_state")


# --- joins ------------------------------------------------------------------------------------------------------------


@R.query("""
    WITH b AS (SELECT degree_level, amount, currency, fee_type, tuition_type, min(id) AS id FROM tuition_patterns GROUP BY ALL)
    SELECT a.id, b.id AS stored_id FROM tuition_patterns a LEFT JOIN b
    ON a.amount = b.amount AND a.tuition_type = b.tuition_type AND a.degree_level IS NOT DISTINCT FROM b.degree_level
       AND a.currency IS NOT DISTINCT FROM b.currency AND a.fee_type IS NOT DISTINCT FROM b.fee_type""")
def join_null_safe_ids(spark: SparkSession, d: str) -> DataFrame:
    """The stored id of every pattern by a five-column key of which three may be null."""
    p = table(spark, d, "tuition_patterns")
    keys = ["amount", "tuition_type", "degree_level", "currency", "fee_type"]
    store = p.groupBy(*keys).agg(F.min("id").alias("id"))
    return merge.map_ids(p, store, keys, null_safe=keys[2:])


@R.query("""
    SELECT u.id, m.id AS stored_id FROM universities u LEFT JOIN universities m ON m.name = u.name""")
def join_ids_by_name(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "universities")
    return merge.map_ids(u, u, ["name"])


@R.query("""
    SELECT count(p.id) AS kept, count(*) - count(p.id) AS skipped FROM program_tuition_map m
    LEFT JOIN (SELECT id FROM degree_programs WHERE quality_flag = 'high') p ON p.id = m.degree_program_id""")
def join_translate_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many map rows find their programme among the good ones, and how many don't."""
    p = table(spark, d, "degree_programs").where("quality_flag = 'high'").select("id", (F.col("id") + 1000).alias("new_id"))
    return merge.translate_ids(table(spark, d, "program_tuition_map"), p, "degree_program_id", "id", "new_id")[1]


def _results(spark: SparkSession, d: str) -> DataFrame:
    """One row per run and domain with the error types met there as an array."""
    return _q(spark, d).groupBy("run_id", "domain").agg(
        F.min("id").alias("result_id"), F.sort_array(F.collect_set("last_error_type")).alias("tags"), F.min("queued_at").alias("created_at")
    )


_RESULTS = """r AS (SELECT run_id, domain, min(id) AS result_id, min(queued_at) AS created_at,
    coalesce(list_sort(list(DISTINCT last_error_type) FILTER (last_error_type IS NOT NULL)), []) AS tags
    FROM crawl_queue_state GROUP BY run_id, domain)"""


@R.query(f"WITH {_RESULTS} SELECT run_id, result_id, t.tag, created_at FROM r, unnest(tags) AS t(tag)")
def lateral_tags(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("run_id", "result_id", F.explode("tags").alias("tag"), "created_at")


@R.query(f"WITH {_RESULTS} SELECT run_id, t.tag, count(*) AS used FROM r, unnest(tags) AS t(tag) GROUP BY run_id, t.tag")
def lateral_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return lateral_tags(spark, d).groupBy("run_id", "tag").agg(F.count(F.lit(1)).alias("used"))


@R.query(f"""
    WITH {_RESULTS} SELECT run_id, count(*) AS results, sum(len(tags))::BIGINT AS tags, count(DISTINCT t.tag) AS distinct_tags,
           min(created_at) AS oldest, max(created_at) AS latest
    FROM r LEFT JOIN LATERAL (SELECT unnest(r.tags) AS tag) t ON true GROUP BY run_id""")
def lateral_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per run, over one row per tag: lengths are counted once for each tag, as in a left lateral join."""
    rows = _results(spark, d).select("*", F.explode_outer("tags").alias("tag"))
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("results"), F.sum(F.size("tags")).alias("tags"), F.countDistinct("tag").alias("distinct_tags"),
        F.min("created_at").alias("oldest"), F.max("created_at").alias("latest"),
    )


@R.query(f"""
    WITH {_RESULTS} SELECT run_id, count(*) AS results, coalesce(sum(len(tags)), 0)::BIGINT AS tags FROM r GROUP BY run_id""")
def lateral_run_summary_fixed(spark: SparkSession, d: str) -> DataFrame:
    """The same counts with each result counted once."""
    return _results(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("results"), F.sum(F.size("tags")).alias("tags"))


@R.query("""
    WITH e AS (SELECT run_id, parent_url, list(DISTINCT child_url) FILTER (source = 'link') AS a,
                      list(DISTINCT child_url) FILTER (source <> 'link') AS b FROM crawl_edges GROUP BY run_id, parent_url)
    SELECT DISTINCT run_id, parent_url, u.url FROM e, LATERAL (SELECT unnest(coalesce(a, [])) AS url UNION SELECT unnest(coalesce(b, [])) UNION SELECT parent_url) u""")
def lateral_union(spark: SparkSession, d: str) -> DataFrame:
    """The distinct urls of two arrays and a single one, per row."""
    e = table(spark, d, "crawl_edges")
    urls = F.explode(F.array_distinct(F.array_compact(F.array(F.when(F.col("source").isNotNull(), F.col("child_url")), "parent_url"))))
    return e.select("run_id", "parent_url", urls.alias("url")).distinct()


@R.query("""
    SELECT r.id AS run_id, coalesce(s.n, 0) AS courses FROM crawl_runs r LEFT JOIN (
        SELECT qs.run_id, count(DISTINCT dp.id) AS n FROM crawl_queue_state qs JOIN degree_programs dp ON dp.source_url = qs.url
        WHERE qs.status = 'done' GROUP BY qs.run_id) s ON s.run_id = r.id""")
def courses_per_run(spark: SparkSession, d: str) -> DataFrame:
    """Programmes that were read from pages which a run has fetched."""
    return relational.courses_per_run(table(spark, d, "crawl_runs"), _q(spark, d), table(spark, d, "degree_programs"))


@R.query("""
    SELECT count(DISTINCT dp.id) AS courses, count(DISTINCT CASE WHEN m.degree_program_id IS NOT NULL THEN dp.id END) AS with_tuition,
           count(DISTINCT CASE WHEN m.degree_program_id IS NULL THEN dp.id END) AS without_tuition,
           count(DISTINCT u.id) AS universities, count(DISTINCT tp.id) AS patterns
    FROM degree_programs dp JOIN universities u ON u.id = dp.university_id
    LEFT JOIN program_tuition_map m ON m.degree_program_id = dp.id LEFT JOIN tuition_patterns tp ON tp.id = m.tuition_pattern_id""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    m = t.program_map.select(F.col("degree_program_id").alias("pid"), F.col("tuition_pattern_id").alias("tid"))
    rows = (
        t.programs.select("id", "university_id").join(t.universities.select(F.col("id").alias("university_id")), "university_id")
        .join(m, F.col("id") == F.col("pid"), "left").join(t.patterns.select(F.col("id").alias("tp")), F.col("tid") == F.col("tp"), "left")
    )
    return rows.agg(
        F.countDistinct("id").alias("courses"), F.countDistinct(F.when(F.col("pid").isNotNull(), F.col("id"))).alias("with_tuition"),
        F.countDistinct(F.when(F.col("pid").isNull(), F.col("id"))).alias("without_tuition"), F.countDistinct("university_id").alias("universities"),
        F.countDistinct("tp").alias("patterns"),
    )


def _tables(spark: SparkSession, d: str) -> search.Tables:
    return search.Tables(*(table(spark, d, n) for n in ("degree_programs", "universities", "tuition_patterns", "program_tuition_map")))


@R.query("""
    SELECT u.id, u.name, count(DISTINCT dp.id) AS courses, count(DISTINCT CASE WHEN m.degree_program_id IS NOT NULL THEN dp.id END) AS with_tuition
    FROM universities u LEFT JOIN degree_programs dp ON dp.university_id = u.id
    LEFT JOIN program_tuition_map m ON m.degree_program_id = dp.id GROUP BY u.id, u.name""")
def university_totals(spark: SparkSession, d: str) -> DataFrame:
    """Programmes of each university, also of those without; counted before the join with universities."""
    t = _tables(spark, d)
    has = t.program_map.select(F.col("degree_program_id").alias("id")).distinct().withColumn("has", F.lit(1))
    n = t.programs.select("id", "university_id").join(has, "id", "left").groupBy("university_id").agg(F.countDistinct("id").alias("courses"), F.countDistinct(F.when(F.col("has") == 1, F.col("id"))).alias("with_tuition"))
    u = t.universities.select("id", "name")
    return u.join(n, u.id == n.university_id, "left").select("id", "name", F.coalesce("courses", F.lit(0)).alias("courses"), F.coalesce("with_tuition", F.lit(0)).alias("with_tuition")).orderBy(F.desc("courses"), "name")


@R.query("""
    SELECT count(*) AS expected, count(*) FILTER (q.url IS NOT NULL) AS fetched, count(*) FILTER (q.url IS NULL) AS missing
    FROM (SELECT DISTINCT run_id, child_url FROM crawl_edges) e LEFT JOIN (SELECT DISTINCT run_id, url FROM crawl_queue_state WHERE status = 'done') q
    ON q.run_id = e.run_id AND q.url = e.child_url""")
def expected_and_fetched(spark: SparkSession, d: str) -> DataFrame:
    """Linked pages that a run fetched (semi join) and that it didn't (anti join)."""
    e = table(spark, d, "crawl_edges").select("run_id", F.col("child_url").alias("url")).distinct()
    q = _q(spark, d).where("status = 'done'").select("run_id", "url")
    got, lost = e.join(q, ["run_id", "url"], "left_semi"), e.join(q, ["run_id", "url"], "left_anti")
    both = got.select(F.lit(1).alias("f")).unionByName(lost.select(F.lit(0).alias("f")))
    return both.agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("f") == 1).alias("fetched"), F.count_if(F.col("f") == 0).alias("missing"))


@R.query("""
    SELECT DISTINCT u.id FROM universities u WHERE NOT EXISTS (
        SELECT 1 FROM universities r WHERE r.created_at >= (SELECT max(created_at) FROM universities) - INTERVAL 6 MONTH
          AND regexp_replace(lower(split_part(split_part(r.url, '//', 2), '/', 1)), '^www\\.', '') = regexp_replace(lower(split_part(split_part(u.url, '//', 2), '/', 1)), '^www\\.', ''))""".replace("\\\\", "\\"))
def exclude_recent_domains(spark: SparkSession, d: str) -> DataFrame:
    """Universities whose domain isn't among those stored within the last six months of the data."""
    u = table(spark, d, "universities").select("id", "created_at", U.without_www(U.logged_domain(F.col("url"))).alias("domain"))
    newest = u.agg(F.max("created_at")).scalar()
    recent = u.where(F.col("created_at") >= newest - F.make_ym_interval(F.lit(0), F.lit(6))).select("domain")
    return u.join(recent, "domain", "left_anti").select("id")


# --- aggregates -------------------------------------------------------------------------------------------------------


@R.query("""
    WITH recent AS (SELECT retry_count FROM crawl_queue_state WHERE queued_at >= (SELECT max(queued_at) FROM crawl_queue_state) - INTERVAL 14 DAY)
    SELECT count(*) AS n, round(avg(retry_count), 2)::DOUBLE AS mean, percentile_cont(0.5) WITHIN GROUP (ORDER BY retry_count)::DOUBLE AS p50,
           percentile_cont(0.75) WITHIN GROUP (ORDER BY retry_count)::DOUBLE AS p75, percentile_cont(0.9) WITHIN GROUP (ORDER BY retry_count)::DOUBLE AS p90, max(retry_count) AS most
    FROM recent""")
def recent_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Retries of the last 14 days of the data: count, mean, quantiles, maximum."""
    q = _recent(spark, d)
    p = lambda x: F.percentile("retry_count", F.lit(x))
    return q.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("retry_count"), 2).alias("mean"), p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.9).alias("p90"), F.max("retry_count").alias("most"))


def _recent(spark: SparkSession, d: str) -> DataFrame:
    newest = _q(spark, d).agg(F.max("queued_at")).scalar()
    return _q(spark, d).where(F.col("queued_at") >= newest - F.expr("INTERVAL 14 DAYS"))


@R.query("""
    SELECT retry_count, count(*) AS row_count FROM crawl_queue_state
    WHERE queued_at >= (SELECT max(queued_at) FROM crawl_queue_state) - INTERVAL 14 DAY GROUP BY retry_count""")
def recent_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d).groupBy("retry_count").agg(F.count(F.lit(1)).alias("row_count")).orderBy("retry_count")


@R.query("SELECT fetch_method, status, count(*) AS row_count FROM crawl_queue_state GROUP BY ALL")
def method_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).groupBy("fetch_method", "status").agg(F.count(F.lit(1)).alias("row_count"))


@R.query("""
    SELECT run_id, domain, depth, status, sum(retry_count + 1)::BIGINT AS hits, min(queued_at) AS first_at, max(queued_at) AS last_at
    FROM crawl_queue_state GROUP BY ALL""")
def additive_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters by a wide key."""
    return _q(spark, d).groupBy("run_id", "domain", "depth", "status").agg(
        F.sum(F.col("retry_count") + 1).alias("hits"), F.min("queued_at").alias("first_at"), F.max("queued_at").alias("last_at")
    )


@R.query("""
    WITH d AS (SELECT domain, count(*) FILTER (status = 'done') AS success, count(*) FILTER (status = 'error') AS failed, count(DISTINCT url) AS visited FROM crawl_queue_state GROUP BY domain)
    SELECT coalesce(domain, '(all)') AS domain, sum(success)::BIGINT AS success, sum(failed)::BIGINT AS failed, sum(visited)::BIGINT AS visited FROM d GROUP BY ROLLUP (domain)""")
def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per domain and in all; the total adds up the domains' compact rows."""
    s = _q(spark, d).groupBy("domain").agg(F.count_if(F.col("status") == "done").alias("success"), F.count_if(F.col("status") == "error").alias("failed"), F.countDistinct("url").alias("visited"))
    return s.rollup("domain").agg(*[F.sum(c).alias(c) for c in ("success", "failed", "visited")]).withColumn("domain", F.coalesce("domain", F.lit("(all)")))


@R.query("""
    SELECT run_id, count(*) FILTER (status IN ('pending', 'processing')) AS unfinished, round(count(*) FILTER (status = 'done') / count(*), 6) AS done_ratio,
           count(*) FILTER (status IN ('pending', 'processing')) = 0 AS idle FROM crawl_queue_state GROUP BY run_id""")
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    """Unfinished tasks, share of finished ones, and whether a run is idle."""
    open_ = F.col("status").isin("pending", "processing")
    return _q(spark, d).groupBy("run_id").agg(
        F.count_if(open_).alias("unfinished"), F.round(F.count_if(F.col("status") == "done") / F.count(F.lit(1)), 6).alias("done_ratio"), (F.count_if(open_) == 0).alias("idle")
    )


@R.query("""
    SELECT course_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM degree_programs), 4)::DOUBLE AS percent
    FROM degree_programs GROUP BY course_type ORDER BY n DESC, course_type LIMIT 15""")
def profile_subjects(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "degree_programs")
    total = p.agg(F.count(F.lit(1))).scalar()
    return p.groupBy("course_type").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.round(F.col("n") * 100.0 / total, 4)).orderBy(F.desc("n"), "course_type").limit(15)


@R.query("""
    SELECT count(*) AS programmes, count(DISTINCT source_url) AS urls, count(DISTINCT program_name) AS names, count(DISTINCT university_id) AS universities,
           round(avg(CASE WHEN is_online THEN 1.0 ELSE 0.0 END), 6) AS online_share FROM degree_programs""")
def profile_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "degree_programs").agg(
        F.count(F.lit(1)).alias("programmes"), F.countDistinct("source_url").alias("urls"), F.countDistinct("program_name").alias("names"),
        F.countDistinct("university_id").alias("universities"), F.round(F.avg(F.when(F.col("is_online"), 1.0).otherwise(0.0)), 6).alias("online_share"),
    )


@R.query("""
    SELECT currency, count(*) AS n, count(DISTINCT amount) AS amounts FROM tuition_patterns GROUP BY currency ORDER BY n DESC, currency NULLS LAST LIMIT 10""")
def profile_currencies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tuition_patterns").groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("amount").alias("amounts")).orderBy(F.desc("n"), F.col("currency").asc_nulls_last()).limit(10)


@R.query("""
    SELECT count(*) AS rows_in, round(coalesce(avg(CASE WHEN status = 'done' THEN 1.0 ELSE 0.0 END), 0), 6) AS done_rate,
           round(coalesce(avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END), 0), 6) AS error_rate, round(coalesce(avg(retry_count), 0), 6)::DOUBLE AS mean_retries,
           count(*) FILTER (url LIKE '%.pdf' AND status = 'error') AS bad_pdfs,
           (count(*) > 0 AND coalesce(avg(CASE WHEN status = 'done' THEN 1.0 ELSE 0.0 END), 0) >= 0.7) AS passed FROM crawl_queue_state""")
def quality_verdict(spark: SparkSession, d: str) -> DataFrame:
    """One row of rates and a verdict; an empty table gives zeros and doesn't pass."""
    share = lambda s: F.coalesce(F.avg(F.when(F.col("status") == s, 1.0).otherwise(0.0)), F.lit(0.0))
    return _q(spark, d).agg(
        F.count(F.lit(1)).alias("rows_in"), F.round(share("done"), 6).alias("done_rate"), F.round(share("error"), 6).alias("error_rate"),
        F.round(F.coalesce(F.avg("retry_count"), F.lit(0.0)), 6).alias("mean_retries"), F.count_if(F.col("url").endswith(".pdf") & (F.col("status") == "error")).alias("bad_pdfs"),
        ((F.count(F.lit(1)) > 0) & (share("done") >= 0.7)).alias("passed"),
    )


@R.query("""
    SELECT run_id, domain, list_sort(list(DISTINCT url) FILTER (depth = 0)) AS starts, max(depth) AS max_depth FROM crawl_queue_state GROUP BY run_id, domain HAVING count(*) FILTER (depth = 0) > 0""")
def targets_to_sites(spark: SparkSession, d: str) -> DataFrame:
    """The start urls and depth of each site of each run."""
    starts = F.sort_array(F.collect_set(F.when(F.col("depth") == 0, F.col("url"))))
    return _q(spark, d).groupBy("run_id", "domain").agg(starts.alias("starts"), F.max("depth").alias("max_depth")).where(F.size("starts") > 0)


@R.query("""
    SELECT domain, CASE WHEN bool_or(depth = 0 AND status = 'done') THEN 1 WHEN bool_or(status = 'done' OR depth <= 2) THEN 2 ELSE 3 END AS depth FROM crawl_queue_state GROUP BY domain""")
def domain_depths(spark: SparkSession, d: str) -> DataFrame:
    """A depth decided by whether any row of the domain meets a condition."""
    done = F.col("status") == "done"
    return _q(spark, d).groupBy("domain").agg(F.when(F.bool_or((F.col("depth") == 0) & done), 1).when(F.bool_or(done | (F.col("depth") <= 2)), 2).otherwise(3).alias("depth"))


@R.query("""
    WITH h AS (SELECT run_id, domain, max(retry_count * 1000 + depth) AS score FROM crawl_queue_state GROUP BY ALL)
    SELECT run_id, domain, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, domain) AS k FROM h) WHERE k <= 3""")
def best_domains(spark: SparkSession, d: str) -> DataFrame:
    """The three domains with the highest best score of each run."""
    h = _q(spark, d).groupBy("run_id", "domain").agg(F.max(F.col("retry_count") * 1000 + F.col("depth")).alias("score"))
    return relational.top_per_group(h, ["run_id"], [F.desc("score"), F.col("domain")], 3)


@R.query("""
    SELECT url, id, retry_count FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY retry_count DESC, id) AS k FROM crawl_queue_state) WHERE k = 1""")
def best_hit_per_url(spark: SparkSession, d: str) -> DataFrame:
    """The row of each url with the highest score; the first to reach it stays."""
    return _q(spark, d).groupBy("url").agg(F.max(F.struct("retry_count", -F.col("id"))).alias("m")).select("url", (-F.col("m.col2")).alias("id"), F.col("m.retry_count").alias("retry_count"))


@R.query("""
    SELECT run_id, count(*) FILTER (status <> 'pending') AS handled, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors, max(updated_at) AS heartbeat FROM crawl_queue_state GROUP BY run_id""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).groupBy("run_id").agg(F.count_if(F.col("status") != "pending").alias("handled"), F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("errors"), F.max("updated_at").alias("heartbeat"))


@R.query("""
    SELECT domain, round(avg(epoch(finished_at - started_at)), 4) AS mean_sec, count(*) FILTER (status = 'error') AS errors FROM crawl_queue_state
    WHERE started_at IS NOT NULL AND finished_at IS NOT NULL GROUP BY domain ORDER BY mean_sec DESC, domain LIMIT 10""")
def slowest_domains(spark: SparkSession, d: str) -> DataFrame:
    sec = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    q = _q(spark, d).where("started_at IS NOT NULL AND finished_at IS NOT NULL")
    return q.groupBy("domain").agg(F.round(F.avg(sec), 4).alias("mean_sec"), F.count_if(F.col("status") == "error").alias("errors")).orderBy(F.desc("mean_sec"), "domain").limit(10)


@R.query(f"WITH {_RESULTS} SELECT coalesce(sum(len(tags)), 0)::BIGINT AS extracted, count(*) AS pages, count(*) FILTER (len(tags) = 0) AS empty_pages FROM r")
def extraction_totals(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).agg(F.coalesce(F.sum(F.size("tags")), F.lit(0)).cast("long").alias("extracted"), F.count(F.lit(1)).alias("pages"), F.count_if(F.size("tags") == 0).alias("empty_pages"))


_WORDS = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@R.query(rf"""
    WITH l AS (SELECT list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
    x AS (SELECT ls[i] AS line, lower(array_to_string(list_slice(ls, greatest(i - 2, 1), i + 2), ' ')) AS near FROM (SELECT ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
    h AS (SELECT *, regexp_matches(line, '[0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]{{4,}}') AS price FROM x WHERE {_WORDS("lower(line)", html.DEGREE_WORDS)}),
    c AS (SELECT CASE WHEN price AND NOT {_WORDS("near", html.FEE_WORDS)} AND NOT regexp_matches(near, '\b(usd|eur|gbp|jpy|aud|cad)\b|[$£€¥円]') THEN 'dropped_fee_context'
                      WHEN NOT price AND NOT regexp_matches(line, '[0-9]') THEN 'dropped_non_numeric' WHEN price THEN 'kept_with_price' ELSE 'kept_without_price' END AS reason FROM h)
    SELECT reason, count(*) AS lines FROM c GROUP BY reason UNION ALL SELECT 'degree_line_hits', count(*) FROM h HAVING count(*) > 0""")
def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What became of the lines that name a degree, counted by the page reader."""
    counts = table(spark, d, "documents").where("text IS NOT NULL").select(html.line_counts(F.col("text")).alias("c"))
    return counts.select(F.explode("c").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("lines"))


# --- windows ----------------------------------------------------------------------------------------------------------


@R.query("""
    SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY university_id, source_url, program_name, course_type, is_online ORDER BY id) AS rn FROM degree_programs) WHERE rn = 1""")
def window_first_of_key(spark: SparkSession, d: str) -> DataFrame:
    keys = ["university_id", "source_url", "program_name", "course_type", "is_online"]
    return relational.dedupe(table(spark, d, "degree_programs"), keys, "id").select("id")


@R.query("SELECT id, row_number() OVER (PARTITION BY run_id, url ORDER BY id) AS attempt_no FROM crawl_queue_state")
def window_attempt_number(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("run_id", "url").orderBy("id")
    return _q(spark, d).select("id", F.row_number().over(w).alias("attempt_no"))


@R.query("""
    WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, lag(event_type) OVER w AS pe, lag(epoch_us(ts)) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         a AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e WHERE pe IS NULL OR pe <> event_type),
         s AS (SELECT user_id, count(gap) AS pairs, min(gap) AS min_gap FROM a GROUP BY user_id),
         r AS (SELECT user_id, count(*) FILTER (pe = event_type) AS retries, min(t - pt) FILTER (pe = event_type) AS min_retry FROM e GROUP BY user_id)
    SELECT r.user_id, pairs, min_gap, retries, min_retry FROM r JOIN s USING (user_id)""")
def window_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Times between different events of a user; repeats directly after an event are one."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    g = relational.gaps(e, "user_id", "t", "event_type", ["t", "event_id"])
    return g.groupBy("user_id").agg(F.count("gap").alias("pairs"), F.min("gap").alias("min_gap"), F.count("retry_gap").alias("retries"), F.min("retry_gap").alias("min_retry"))


@R.query("""
    SELECT domain, url, count(*) AS requests, arg_max(status, id) AS last_status FROM crawl_queue_state GROUP BY domain, url""")
def window_last_response(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).groupBy("domain", "url").agg(F.count(F.lit(1)).alias("requests"), F.max_by("status", "id").alias("last_status"))


@R.query("""
    WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM documents),
         p AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)
    SELECT doc_id, i AS line_no, array_to_string(list_slice(ls, greatest(i - 2, 1), i + 2), ' ') AS context FROM p""")
def window_context(spark: SparkSession, d: str) -> DataFrame:
    """Each line with two lines before and after it."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", relational.neighbours(lines, 2, 2).alias("c"))
    return rows.select("doc_id", F.posexplode("c").alias("p", "context")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "context")


@R.query("""
    SELECT domain AS key, row_number() OVER (ORDER BY min(id)) AS domain_id FROM crawl_queue_state WHERE domain IS NOT NULL GROUP BY domain""")
def window_first_seen_ids(spark: SparkSession, d: str) -> DataFrame:
    return relational.dense_ids(_q(spark, d), F.col("domain"), F.col("id"), "domain_id")


@R.query("""
    SELECT university_id, arg_min(id, id) AS first_id, arg_max(id, id) AS last_id, arg_max(quality_flag, id) AS last_flag FROM degree_programs GROUP BY university_id""".replace("arg_max(quality_flag, id)", "arg_max_null(quality_flag, id)"))
def window_first_and_last(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each key and the last; either may win in a batch."""
    p = table(spark, d, "degree_programs")
    first = relational.dedupe(p, ["university_id"], "id", "first").select("university_id", F.col("id").alias("first_id"))
    last = relational.dedupe(p, ["university_id"], "id", "last").select("university_id", F.col("id").alias("last_id"), F.col("quality_flag").alias("last_flag"))
    return first.join(last, "university_id")


@R.query("""
    WITH g AS (SELECT domain, url, min(id) AS id FROM crawl_queue_state GROUP BY domain, url), o AS (SELECT domain, min(id) AS o FROM g GROUP BY domain),
         p AS (SELECT url, o, row_number() OVER (PARTITION BY g.domain ORDER BY id) AS k FROM g JOIN o USING (domain)),
         f AS (SELECT url, k, o, row_number() OVER (PARTITION BY url ORDER BY k, o) AS r FROM p WHERE k <= 3)
    SELECT url FROM f WHERE r = 1 ORDER BY k, o, url LIMIT 24""")
def window_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Urls taken one from each domain in turn, 24 in all."""
    g = _q(spark, d).groupBy("domain", "url").agg(F.min("id").alias("id"))
    some = relational.top_per_group(g, ["domain"], [F.col("id")], 3)
    w = Window.partitionBy("domain").orderBy("id")
    rows = some.withColumn("k", F.row_number().over(w)).withColumn("o", F.min("id").over(Window.partitionBy("domain")))
    return relational.round_robin(rows, "o", "k", "url", 24).select("url")


# --- top-k and sets ---------------------------------------------------------------------------------------------------


@R.query("""
    SELECT domain, id FROM (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY queued_at, id) AS k FROM crawl_queue_state WHERE status = 'pending') WHERE k <= 16""")
def top_pending(spark: SparkSession, d: str) -> DataFrame:
    """The 16 oldest pending rows of each domain."""
    return relational.top_per_group(_q(spark, d).where("status = 'pending'"), ["domain"], [F.col("queued_at"), F.col("id")], 16).select("domain", "id")


@R.query("""
    SELECT domain, count(*) AS open_rows, min(queued_at) AS since FROM crawl_queue_state WHERE status = 'processing' GROUP BY domain ORDER BY open_rows DESC, since, domain LIMIT 10""")
def stuck_sites(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).where("status = 'processing'").groupBy("domain").agg(F.count(F.lit(1)).alias("open_rows"), F.min("queued_at").alias("since")).orderBy(F.desc("open_rows"), "since", "domain").limit(10)


@R.query("SELECT last_error_type, count(*) AS n, min(id) AS first_id FROM crawl_queue_state WHERE last_error_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, first_id")
def most_common_errors(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).where("last_error_type IS NOT NULL").groupBy("last_error_type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("n"), "first_id")


@R.query("""
    SELECT url, domain FROM (SELECT url, domain, dense_rank() OVER (PARTITION BY domain ORDER BY first) AS k FROM (SELECT domain, url, min(id) AS first FROM crawl_queue_state GROUP BY domain, url)) WHERE k <= 20""")
def first_urls_per_domain(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 different urls of each domain."""
    g = _q(spark, d).groupBy("domain", "url").agg(F.min("id").alias("first"))
    return relational.top_per_group(g, ["domain"], [F.col("first")], 20).select("url", "domain")


@R.query("""
    WITH e AS (SELECT run_id, parent_url, list(DISTINCT child_url) FILTER (source = 'link') AS a, list(DISTINCT child_url) FILTER (source = 'sitemap') AS b FROM crawl_edges GROUP BY ALL)
    SELECT run_id, parent_url, len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS children FROM e""")
def merge_link_sets(spark: SparkSession, d: str) -> DataFrame:
    """Two sets of children united."""
    both = F.when(F.col("source").isin("link", "sitemap"), F.col("child_url"))
    return table(spark, d, "crawl_edges").groupBy("run_id", "parent_url").agg(F.countDistinct(both).alias("children"))


@R.query("""
    WITH x AS (SELECT *, row_number() OVER (PARTITION BY run_id, parent_url, child_url, source ORDER BY id) AS k FROM crawl_edges) SELECT id FROM x WHERE k = 1""")
def distinct_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links without their repeats."""
    return relational.dedupe(table(spark, d, "crawl_edges"), ["run_id", "parent_url", "child_url", "source"], "id").select("id")


# --- access log over the events table ---------------------------------------------------------------------------------


def _events_run(spark: SparkSession, d: str) -> accesslog.Run:
    e = table(spark, d, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    reqs = e.select(
        F.concat(F.lit("h"), (F.col("user_id") % 50).cast("string")).alias("host"), F.concat(F.lit("/"), "event_type", F.lit("-"), (F.col("user_id") % 7).cast("string")).alias("path"),
        t.alias("recv_ts"), (t + F.col("value") / 1000).alias("send_ts"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.lit("ok").alias("response_type"), F.lit(0).alias("injected_delay_ms"), F.lit("sent").alias("outcome"), F.concat(F.lit("ip"), (F.col("user_id") % 3).cast("string")).alias("client_ip"),
        F.lit("events-run1").alias("run_label"), F.col("event_id").alias("line"),
    )
    n = F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")
    hosts = spark.range(1).select(n).select(F.concat(F.lit("h"), F.col("i").cast("string")).alias("host"), F.lit("p").alias("profile"), F.lit(60).alias("crawl_delay"), F.when(F.col("i") % 5 == 0, "404").otherwise("200").alias("robots_status"))
    pages = reqs.select("host", "path").distinct().select("host", "path", F.lit("200").alias("status"), F.lit("1").alias("reachable"))
    workers = spark.range(1).select(F.lit("ip0").alias("client_ip"), F.lit("w0").alias("worker_id"))
    return accesslog.Run(reqs, hosts, pages, workers)


_LOG = """r AS (SELECT 'h' || (user_id % 50) AS host, '/' || event_type || '-' || (user_id % 7) AS path, epoch_us(ts) / 1e6 AS t, event_id AS line, event_type <> 'error' AS ok,
    CASE WHEN user_id % 3 = 0 THEN 'w0' ELSE 'ip' || (user_id % 3) END AS worker, value FROM events)"""


@R.query(f"""
    WITH {_LOG}, x AS (SELECT *, lag(path) OVER w AS pp, lag(t) OVER w AS pt FROM r WINDOW w AS (PARTITION BY host ORDER BY t, line)),
         a AS (SELECT *, t - lag(t) OVER (PARTITION BY host ORDER BY t, line) AS gap FROM x WHERE pp IS NULL OR pp <> path),
         g AS (SELECT host, count(gap) AS pairs, round(min(gap), 5) AS min_interval, count(*) FILTER (gap < 59.95) AS short FROM a GROUP BY host)
    SELECT x.host, any_value(substr(x.host, 2)::INT % 5 <> 0) AS applicable, count(*) AS page_requests, any_value(pairs) AS pairs, any_value(min_interval) AS min_interval,
           CASE WHEN any_value(substr(x.host, 2)::INT % 5 <> 0) THEN any_value(short) END AS violations, count(*) FILTER (pp = path) AS retry_pairs, count(DISTINCT worker) AS clients
    FROM x JOIN g USING (host) GROUP BY x.host""")
def log_crawl_delay(spark: SparkSession, d: str) -> DataFrame:
    """Delay kept between fetches per host, over the events table read as an access log."""
    rows = accesslog.crawl_delay(_events_run(spark, d)).where("page_requests > 0")
    return rows.select("host", "applicable", "page_requests", "pairs", F.round("min_interval", 5).alias("min_interval"), "violations", "retry_pairs", "clients")


@R.query(f"""
    WITH {_LOG}, u AS (SELECT host, path, count(*) AS n, arg_max(ok, (t, line)) AS ok FROM r GROUP BY ALL)
    SELECT (SELECT count(*) FROM r) AS requests, count(*) AS urls, count(*) FILTER (n > 1) AS retried_urls, count(*) FILTER (NOT ok) AS failed_urls,
           (SELECT round(quantile_cont(value, 0.95), 2) FROM r) AS latency_p95, (SELECT count(DISTINCT worker) FROM r) AS workers,
           (SELECT round(max(t + value / 1000) - min(t), 3) FROM r) AS total_time_sec FROM u""")
def log_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = accesslog.run_metrics(_events_run(spark, d))
    return m.select("requests", "urls", "retried_urls", "failed_urls", F.round("latency_p95", 2).alias("latency_p95"), "workers", F.round("total_time_sec", 3).alias("total_time_sec"))


@R.query(f"WITH {_LOG} SELECT worker, count(*) AS page_requests FROM r GROUP BY worker")
def log_requests_by_worker(spark: SparkSession, d: str) -> DataFrame:
    return accesslog.requests_by_worker(_events_run(spark, d))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.oracles
