"""Queries of the transform, the merges, the frontier and the scenario generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkademia.functions import urls as U
from sparkademia.operators import frontier, merge, relational, transform
from sparkademia.plans.registry import Registry
from sparkademia.session import table

R = Registry()


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Page records made from the documents: the first line is the title, each line with a figure a degree."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[0-9]{4}"))
    degree = lambda x: F.struct(
        x.alias("name"), F.regexp_extract(x, "([0-9]{4})", 1).cast("long").alias("price"), F.when(x.contains("£"), "GBP").when(x.contains("$"), "USD").alias("currency"),
        F.when(x.contains("Engineering"), "engineering").otherwise("general").alias("course_type"), x.contains("online").alias("is_online"), F.lit(None).cast("string").alias("limit"), x.alias("context"),
        F.lit(None).cast("string").alias("tuition_type"), F.lit(None).cast("long").alias("amount_min"), F.lit(None).cast("long").alias("amount_max"),
        F.lit(None).cast("double").alias("normalized_monthly_amount"), F.lit(None).cast("string").alias("normalization_note"),
    )
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("ordinal"), "url", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), U.country(F.col("url")).alias("country"),
        F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.transform(lines, degree).alias("degrees"), F.col("text").alias("raw_text"),
    )


_DEG = r"""deg AS (
    SELECT doc_id, url, split_part(coalesce(split_part(text, chr(10), 1), ''), ' - ', 1) AS title, fetched_at, unnest(range(0, greatest(len(ls), 1))) AS pos, ls
    FROM (SELECT *, coalesce(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]{4}')), []) AS ls FROM documents)),
    row AS (SELECT *, ls[pos + 1] AS x, row_number() OVER (ORDER BY doc_id, pos) AS id FROM deg),
    f AS (SELECT id, doc_id, url, trim(title, ' ') AS program_name, fetched_at, x,
           CASE WHEN x IS NULL THEN NULL ELSE regexp_extract(x, '([0-9]{4})', 1)::BIGINT END AS amount,
           CASE WHEN contains(x, '£') THEN 'GBP' WHEN contains(x, '$') THEN 'USD' END AS currency,
           CASE WHEN contains(x, 'Engineering') THEN 'engineering' ELSE 'general' END AS course_type, coalesce(contains(x, 'online'), false) AS is_online,
           lower(CASE WHEN x IS NULL THEN trim(title, ' ') ELSE x END) AS n FROM row),
    g AS (SELECT *, CASE WHEN contains(trim(n, ' '), 'phd') OR contains(trim(n, ' '), 'doctorate') OR contains(trim(n, ' '), '博士') THEN 'PhD'
                WHEN contains(trim(n, ' '), 'bachelor') OR contains(trim(n, ' '), 'undergraduate') OR contains(trim(n, ' '), 'bsc') OR contains(trim(n, ' '), 'beng') OR contains(trim(n, ' '), 'ba ') OR contains(trim(n, ' '), '学士') THEN 'Bachelor'
                WHEN contains(trim(n, ' '), 'master') OR contains(trim(n, ' '), 'postgraduate') OR contains(trim(n, ' '), 'graduate') OR contains(trim(n, ' '), 'msc') OR contains(trim(n, ' '), 'meng') OR contains(trim(n, ' '), 'ma ') OR contains(trim(n, ' '), '修士') THEN 'Master'
                ELSE 'Other' END AS degree_level FROM f)"""


@R.query(f"""
    WITH {_DEG} SELECT id, program_name, course_type, is_online, url AS source_url, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS last_seen,
           CASE WHEN course_type = 'general' OR amount IS NULL OR currency IS NULL THEN 'low' ELSE 'high' END AS quality_flag FROM g""")
def transform_programs(spark: SparkSession, d: str) -> DataFrame:
    return transform.transform(_records(spark, d)).degree_programs.drop("university_id")


@R.query(f"""
    WITH {_DEG}, p AS (SELECT degree_level, amount, currency, min(id) AS first_at FROM g WHERE amount IS NOT NULL AND currency IS NOT NULL GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY first_at) AS id, degree_level, amount, currency FROM p""")
def transform_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns numbered as they are first met."""
    return transform.transform(_records(spark, d)).tuition_patterns.select("id", "degree_level", "amount", "currency")


@R.query(f"""
    WITH {_DEG}, k AS (SELECT *, dense_rank() OVER (ORDER BY first_at) AS pid FROM (SELECT id, min(id) OVER (PARTITION BY degree_level, amount, currency) AS first_at FROM g WHERE amount IS NOT NULL AND currency IS NOT NULL))
    SELECT id AS degree_program_id, pid AS tuition_pattern_id FROM k""")
def transform_map(spark: SparkSession, d: str) -> DataFrame:
    return transform.transform(_records(spark, d)).program_tuition_map


@R.query(rf"""
    WITH {_DEG}, k AS (SELECT lower(trim(x, ' ')) AS a, amount, coalesce(currency, '') AS c, course_type FROM g WHERE x IS NOT NULL), n AS (SELECT count(*) AS n FROM k GROUP BY a, amount, c, course_type)
    SELECT coalesce(sum(n), 0)::BIGINT AS total, count(*) AS unique_groups, count(*) FILTER (n > 1) AS repeated_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS repeated_items FROM n""")
def duplicate_stats(spark: SparkSession, d: str) -> DataFrame:
    """Repeats among all degrees of all pages, by context, name, price, currency and subject."""
    return transform.repeated_degrees(_records(spark, d))


@R.query(r"""
    WITH p AS (SELECT doc_id, url, coalesce(split_part(text, chr(10), 1), '') AS title, text, coalesce(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]{4}')), []) AS ls,
                      regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(url, ''), '^\s+|\s+$', '', 'g')), '(?s)#.*', ''), '(?s)\?.*', ''), '/20\d{2}/', '/', 'g'), '/+$', '') AS u FROM documents),
    k AS (SELECT *, lower(trim(title, ' ')) AS t FROM p),
    x AS (SELECT u, t, unnest(ls) AS l FROM k),
    n AS (SELECT u, t, count(DISTINCT (lower(trim(l, ' ')), regexp_extract(l, '([0-9]{4})', 1), CASE WHEN contains(l, '£') THEN 'GBP' WHEN contains(l, '$') THEN 'USD' ELSE '' END, contains(l, 'Engineering'))) AS n FROM x GROUP BY u, t)
    SELECT min(doc_id) AS ordinal, arg_min(url, doc_id) AS url, max(length(text)) AS longest, coalesce(any_value(n.n), 0)::INT AS degrees FROM k LEFT JOIN n USING (u, t) GROUP BY u, t""")
def merge_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with one canonical address and title are one: the first's address, the longest text, all their degrees."""
    return transform.merge_records(_records(spark, d)).select("ordinal", "url", F.length("raw_text").alias("longest"), F.size("degrees").alias("degrees"))


@R.query(f"""
    WITH {_DEG}, p AS (SELECT DISTINCT degree_level, amount, currency FROM g WHERE amount IS NOT NULL AND currency IS NOT NULL)
    SELECT 'degree_programs_in' AS name, (SELECT count(*) FROM g) AS n UNION ALL SELECT 'degree_programs_skipped', (SELECT count(*) FROM g WHERE program_name = '')
    UNION ALL SELECT 'tuition_patterns_in', (SELECT count(*) FROM p) UNION ALL SELECT 'tuition_patterns_inserted', (SELECT count(*) FROM p)
    UNION ALL SELECT 'program_tuition_map_in', (SELECT count(*) FROM g WHERE amount IS NOT NULL AND currency IS NOT NULL)
    UNION ALL SELECT 'program_tuition_map_skipped', (SELECT count(*) FROM g WHERE amount IS NOT NULL AND currency IS NOT NULL AND program_name = '')""")
def load_summary(spark: SparkSession, d: str) -> DataFrame:
    """What a chunk of transformed records brings into empty tables but for the universities' own, in counts."""
    chunk = transform.transform(_records(spark, d))
    stores = {"universities": table(spark, d, "universities"), "degree_programs": chunk.degree_programs.limit(0), "tuition_patterns": chunk.tuition_patterns.limit(0), "program_tuition_map": chunk.program_tuition_map.limit(0)}
    _, counts = merge.load_chunk(chunk, stores)
    names = ("degree_programs_in", "degree_programs_skipped", "tuition_patterns_in", "tuition_patterns_inserted", "program_tuition_map_in", "program_tuition_map_skipped")
    return spark.createDataFrame([(n, counts[n]) for n in names], "name string, n long")


# Each merge brings the whole table to the version of it that existed half-way through its time.


@R.query("""
    WITH t AS (SELECT to_timestamp((epoch(min(created_at)) + epoch(max(created_at))) // 2)::TIMESTAMP AS half FROM universities)
    SELECT name, 'XX' AS country, url, TIMESTAMP '2026-10-01 00:00:00' AS updated_at, CASE WHEN created_at < half THEN created_at END AS created_at
    FROM universities, t""")
def merge_universities(spark: SparkSession, d: str) -> DataFrame:
    """Universities upserted by name: country, url and time are overwritten, created_at stays."""
    u = table(spark, d, "universities")
    batch = u.select("id", "name", F.lit("XX").alias("country"), "url", F.lit("2026-10-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    rule = merge.MergeRule(keys=("name",), update=("country", "url", "updated_at"))
    return merge.upsert(_earlier(u), batch, rule, "id", "id").select("name", "country", "url", "updated_at", "created_at")


def _earlier(df: DataFrame) -> DataFrame:
    """The rows created in the first half of the table's time."""
    sec = F.unix_seconds(F.col("created_at").cast("timestamp"))
    half = df.agg(F.floor((F.min(sec) + F.max(sec)) / 2)).scalar()
    return df.where(sec < half)


@R.query("""
    WITH t AS (SELECT to_timestamp((epoch(min(created_at)) + epoch(max(created_at))) // 2)::TIMESTAMP AS half FROM degree_programs),
         e AS (SELECT *, row_number() OVER (PARTITION BY university_id, source_url, program_name, course_type, is_online ORDER BY id) AS k FROM degree_programs, t WHERE created_at < half),
         b AS (SELECT *, row_number() OVER (PARTITION BY university_id, source_url, program_name, course_type, is_online ORDER BY id) AS k FROM degree_programs)
    SELECT b.university_id, b.source_url, b.program_name, b.last_seen, b.quality_flag, coalesce(e.created_at, b.created_at) AS created_at
    FROM (SELECT * FROM b WHERE k = 1) b LEFT JOIN (SELECT * FROM e WHERE k = 1) e
    ON e.university_id = b.university_id AND e.source_url = b.source_url AND e.program_name = b.program_name AND e.course_type = b.course_type AND e.is_online IS NOT DISTINCT FROM b.is_online""")
def merge_programs(spark: SparkSession, d: str) -> DataFrame:
    """Programmes upserted by their five-column key: of a batch the first row counts, and only last_seen and quality_flag
    change."""
    p = table(spark, d, "degree_programs")
    keys = ("university_id", "source_url", "program_name", "course_type", "is_online")
    rule = merge.MergeRule(keys=keys, update=("last_seen", "quality_flag"), keep="first")
    existing = relational.dedupe(_earlier(p), list(keys), "id")
    return merge.upsert(existing, p, rule, "id").select("university_id", "source_url", "program_name", "last_seen", "quality_flag", "created_at")


@R.query("""
    WITH k AS (SELECT *, degree_level IS NULL OR amount IS NULL OR currency IS NULL OR fee_type IS NULL OR tuition_type IS NULL AS open FROM tuition_patterns),
         t AS (SELECT to_timestamp((epoch(min(created_at)) + epoch(max(created_at))) // 2)::TIMESTAMP AS half FROM tuition_patterns),
         l AS (SELECT degree_level, amount, currency, fee_type, tuition_type, arg_max_null(normalized_monthly_amount, id) AS monthly, arg_max_null(normalization_note, id) AS note FROM k WHERE NOT open GROUP BY ALL)
    SELECT * FROM l UNION ALL SELECT degree_level, amount, currency, fee_type, tuition_type, normalized_monthly_amount, normalization_note FROM k WHERE open
    UNION ALL SELECT degree_level, amount, currency, fee_type, tuition_type, normalized_monthly_amount, normalization_note FROM k, t WHERE open AND created_at < half""")
def merge_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of which the last row of a key counts; a key with a null is never the same as another, so the rows of the
    earlier version that have one are there twice."""
    p = table(spark, d, "tuition_patterns")
    keys = ("degree_level", "amount", "currency", "fee_type", "tuition_type")
    rule = merge.MergeRule(keys=keys, update=("amount_min", "amount_max", "normalized_monthly_amount", "normalization_note"), null_keys="append")
    out = merge.upsert(merge.collapse_batch(_earlier(p), rule, "id"), p, rule, "id")
    return out.select(*keys, F.col("normalized_monthly_amount").alias("monthly"), F.col("normalization_note").alias("note"))


@R.query("SELECT DISTINCT degree_program_id, tuition_pattern_id FROM program_tuition_map")
def merge_map(spark: SparkSession, d: str) -> DataFrame:
    """Pairs inserted unless they are there: the pairs of earlier programmes first, then all."""
    m = table(spark, d, "program_tuition_map")
    early = m.join(_earlier(table(spark, d, "degree_programs")).select(F.col("id").alias("degree_program_id")), "degree_program_id", "left_semi")
    return merge.insert_ignore(early.distinct(), m, ["degree_program_id", "tuition_pattern_id"])


@R.query("""
    WITH b AS (SELECT run_id, url, arg_max(status, id) AS status, arg_max(fetch_method, id) FILTER (fetch_method IS NOT NULL AND fetch_method <> '') AS fetch_method,
                      arg_max(started_at, id) FILTER (started_at IS NOT NULL) AS started_at FROM crawl_queue_state GROUP BY run_id, url)
    SELECT * FROM b""")
def merge_queue_states(spark: SparkSession, d: str) -> DataFrame:
    """Per run and url the last status, and the last method and start that aren't empty: the states of the first half of the
    rows, merged with those of the second."""
    q = table(spark, d, "crawl_queue_state").select("id", "run_id", "url", "status", "fetch_method", "started_at")
    half = F.floor(q.agg(F.max("id")).scalar() / 2)
    rule = merge.MergeRule(keys=("run_id", "url"), update=("status", "id"), fill=("fetch_method", "started_at"))
    old, new = (merge.last_values(q.where(w), rule, "id") for w in (F.col("id") <= half, F.col("id") > half))
    return merge.upsert(old, new, rule, "id").drop("id")


@R.query("SELECT (SELECT count(*) FROM degree_programs) AS degree_programs, (SELECT count(*) FROM universities) AS universities, true AS equal")
def refresh_verified(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of a copied store against the original."""
    from sparkademia.session import Workspace
    from sparkademia.sources.stores import copy_store, verify_store

    names = ["degree_programs", "universities"]
    space = Workspace(spark, "copy")
    copy_store({n: table(spark, d, n) for n in names}, f"{space.root}/store")
    v = verify_store({n: table(spark, d, n) for n in names}, spark, f"{space.root}/store")
    return v.groupBy().pivot("table", names).agg(F.first("copied")).withColumn("equal", v.agg(F.bool_and("equal")).scalar())


# --- frontier and scenarios -------------------------------------------------------------------------------------------


@R.query("""
    WITH RECURSIVE e AS (SELECT DISTINCT run_id, parent_url AS p, child_url AS c FROM crawl_edges),
    s AS (SELECT DISTINCT run_id, p AS url FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.run_id = e.run_id AND x.c = e.p)),
    r AS (SELECT run_id, url FROM s UNION SELECT r.run_id, e.c FROM r JOIN e ON e.run_id = r.run_id AND e.p = r.url)
    SELECT run_id, count(*) AS pages FROM r GROUP BY run_id""")
def reachable_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each run that can be reached from pages without a parent."""
    e = table(spark, d, "crawl_edges").select(F.col("run_id").alias("host"), F.col("parent_url").alias("path"), F.col("child_url").alias("child")).distinct()
    pages = e.select("host", "path").union(e.select("host", "child")).distinct().withColumn("status", F.lit("200"))
    starts = e.select("host", "path").distinct().join(e.select("host", F.col("child").alias("path")), ["host", "path"], "left_anti")
    return frontier.reachable(pages, e, starts).groupBy(F.col("host").alias("run_id")).agg(F.count(F.lit(1)).alias("pages"))


@R.query("""
    WITH n AS (SELECT child_domain AS domain, child_url AS url, min(e.depth) AS depth FROM crawl_edges e WHERE e.depth <= 3 GROUP BY ALL),
         a AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM crawl_queue_state q WHERE q.domain = n.domain AND q.url = n.url))
    SELECT domain, url, depth FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY depth, url) AS k FROM a) WHERE k <= 10""")
def frontier_admitted(spark: SparkSession, d: str) -> DataFrame:
    """New pages that may be queued: at most three deep, unknown, ten a domain."""
    e = table(spark, d, "crawl_edges").select(F.col("child_domain").alias("domain"), F.col("child_url").alias("url"), "depth")
    return frontier.admit(e, table(spark, d, "crawl_queue_state"), 3, 10)


@R.query("""
    WITH e AS (SELECT DISTINCT parent_url, child_url FROM crawl_edges), f AS (SELECT DISTINCT child_domain AS domain, child_url AS url, depth FROM crawl_edges)
    SELECT f.domain, e.child_url AS url, min(f.depth + 1) AS depth FROM f JOIN e ON e.parent_url = f.url GROUP BY ALL""")
def frontier_expanded(spark: SparkSession, d: str) -> DataFrame:
    """The pages that linked pages link to, one level deeper."""
    e = table(spark, d, "crawl_edges")
    f = e.select(F.col("child_domain").alias("domain"), F.col("child_url").alias("url"), "depth").distinct()
    return frontier.expand(f, e.select(F.col("parent_url").alias("url"), F.col("child_url").alias("child")).distinct())


@R.query("""
    WITH e AS (SELECT source, target_share, 1000 * target_share AS x, floor(1000 * target_share) AS n FROM mix_targets),
         r AS (SELECT *, row_number() OVER (ORDER BY x - n DESC, source) AS k, 1000 - sum(n) OVER () AS rest FROM e)
    SELECT source, (n + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS count FROM r""")
def allocate_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "mix_targets").select("source", "target_share", F.col("source").alias("o"))
    return relational.largest_remainder(t, 1000, "source", "target_share", "o").select("source", "count")


@R.query("""
    WITH RECURSIVE h AS (SELECT 'u' || id AS host, id % 40 AS n FROM universities), p AS (SELECT host, unnest(range(0, n + 1)) AS page FROM h),
         t AS (SELECT host, page, NULL::BIGINT AS parent, 0 AS depth FROM p WHERE page = 0
               UNION ALL SELECT p.host, p.page, (p.page - 1) // 3, t.depth + 1 FROM p JOIN t ON t.host = p.host AND t.page = (p.page - 1) // 3 WHERE p.page > 0)
    SELECT host, page, parent, depth FROM t""")
def scenario_tree(spark: SparkSession, d: str) -> DataFrame:
    """The page trees of generated sites."""
    hosts = table(spark, d, "universities").select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("host"), (F.col("id") % 40).alias("n"))
    return relational.page_tree(hosts, 3)


@R.query("""
    SELECT country, count(*) AS domains, round(sum(1.0 / (1 + id % 5)), 6) AS capacity, max((id % 40 - 1) * (1 + id % 5)) AS time_bound FROM universities GROUP BY country""")
def scenario_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sites, fetches a second and the longest site per group of generated sites."""
    delay = 1 + F.col("id") % 5
    return table(spark, d, "universities").groupBy("country").agg(
        F.count(F.lit(1)).alias("domains"), F.round(F.sum(1.0 / delay), 6).alias("capacity"), F.max((F.col("id") % 40 - 1) * delay).alias("time_bound")
    )


@R.query(r"""
    WITH s AS (SELECT min(id) AS id, 'https://' || domain AS root, domain, bool_or(status = 'done') AS listed, 1 + min(id) % 3 AS depth,
                      count(*) FILTER (status = 'done') AS hits, count(*) FILTER (status = 'error') AS errors FROM crawl_queue_state WHERE domain IS NOT NULL GROUP BY run_id, domain)
    SELECT root, arg_max(depth, id) AS depth FROM s WHERE listed AND hits >= 8 AND errors <= 3 AND depth <= 2
    AND NOT (domain = 'x.com' OR domain LIKE '%.x.com') GROUP BY root""")
def seed_targets(spark: SparkSession, d: str) -> DataFrame:
    """Start urls of results that pass thresholds; the newest result wins a root. A result is a domain of a run."""
    status = lambda s: F.col("status") == s
    g = table(spark, d, "crawl_queue_state").where("domain IS NOT NULL").groupBy("run_id", "domain").agg(
        F.min("id").alias("id"), F.bool_or(status("done")).alias("listed"), F.count_if(status("done")).alias("hits"), F.count_if(status("error")).alias("errors")
    )
    root = F.concat(F.lit("https://"), F.col("domain"))
    r = g.select("id", F.concat(root, F.lit("/list")).alias("source_url"), F.array(root).alias("roots"), F.array().cast("array<string>").alias("details"), "listed", (1 + F.col("id") % 3).cast("int").alias("depth"), "hits", "errors")
    return frontier.seed_targets(r, 8, 3, 2)


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.oracles
