"""Streaming operators run over the tables as files that arrive, and page extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkademia.functions import html
from sparkademia.plans.registry import Registry
from sparkademia.session import Workspace, table
from sparkademia.streaming import queue_log, state

R = Registry()


def _drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that a streaming query gives for what is there now, as a table."""
    spark = df.sparkSession
    space = Workspace(spark, "stream")
    out = f"{space.root}/out-{uuid.uuid4().hex[:6]}"
    sink = lambda b, i: b.write.mode("append").parquet(out)
    w = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{space.root}/checkpoint")
    w.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


@R.query("""
    SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
    GROUP BY 1, 2""")
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type, from a stream with late rows (an addition)."""
    e = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _drain(queue_log.event_windows(e, "1 day", "10 days"), "complete")
    return rows.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@R.query("""
    SELECT domain, url, depth, count(*) AS n FROM (SELECT DISTINCT domain, url, depth FROM crawl_queue_state WHERE domain IS NOT NULL AND url IS NOT NULL) GROUP BY ALL""")
def stream_distinct_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Each task once, from a stream."""
    q = _stream(spark, d, "crawl_queue_state").select("domain", "url", "depth").where("domain IS NOT NULL AND url IS NOT NULL")
    return _drain(queue_log.distinct_tasks(q)).withColumn("n", F.lit(1).cast("long"))


@R.query("""
    WITH RECURSIVE t AS (SELECT DISTINCT domain || ' ' || url AS k, epoch_us(queued_at) // 1000000 AS s FROM crawl_queue_state WHERE domain IS NOT NULL AND url IS NOT NULL AND queued_at IS NOT NULL),
    f AS (SELECT k, min(s) AS seen_at FROM t GROUP BY k UNION ALL
          SELECT k, n FROM (SELECT f.k, (SELECT min(t.s) FROM t WHERE t.k = f.k AND t.s >= f.seen_at + 864000) AS n FROM f) WHERE n IS NOT NULL)
    SELECT k, seen_at FROM f""")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Each url's first sight within ten days, from a stream; when they are over it comes out again."""
    q = _stream(spark, d, "crawl_queue_state").where("domain IS NOT NULL AND url IS NOT NULL AND queued_at IS NOT NULL")
    rows = q.select(F.concat_ws(" ", "domain", "url").alias("k"), F.date_trunc("second", "queued_at").alias("at"))
    return _drain(state.first_seen(rows, "k", "at", 864000)).select("k", F.unix_seconds("at").alias("seen_at"))


@R.query("""
    WITH q AS (SELECT domain, url, epoch_us(queued_at) / 1e6 AS t FROM crawl_queue_state WHERE domain IS NOT NULL AND queued_at IS NOT NULL),
         n AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY t, url) - 1) * 2.0 AS k FROM q)
    SELECT domain, url, 'reserve' AS kind, t AS at, round(k + m, 3) AS start, round(k + m - t, 3) AS wait_sec FROM (
        SELECT *, max(t - k) OVER (PARTITION BY domain ORDER BY t, url ROWS UNBOUNDED PRECEDING) AS m FROM n)""")
def stream_slots(spark: SparkSession, d: str) -> DataFrame:
    """Start and waiting time of each request, two seconds apart per domain, from a stream."""
    q = _stream(spark, d, "crawl_queue_state").where("queued_at IS NOT NULL")
    at = F.unix_micros("queued_at") / 1e6
    req = q.select("domain", "url", F.lit("reserve").alias("kind"), at.alias("at"), F.lit(2.0).alias("delay"))
    return _drain(state.reserve_slots(req, None)).withColumn("start", F.round("start", 3)).withColumn("wait_sec", F.round("wait_sec", 3))


@R.query("""
    WITH q AS (SELECT domain, url, epoch_us(queued_at) / 1e6 AS t FROM crawl_queue_state WHERE queued_at IS NOT NULL),
         n AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY t, url) - 1) * 2.0 AS k FROM q)
    SELECT domain, round(sum(k + m - t), 3) AS total_wait, round(max(k + m - t), 3) AS longest_wait FROM (
        SELECT *, max(t - k) OVER (PARTITION BY domain ORDER BY t, url ROWS UNBOUNDED PRECEDING) AS m FROM n) GROUP BY domain""")
def slots_closed_form(spark: SparkSession, d: str) -> DataFrame:
    """Waiting times by the closed form over a finished table."""
    q = table(spark, d, "crawl_queue_state").where("queued_at IS NOT NULL")
    rows = state.reserve_slots_batch(q.select("domain", "url", (F.unix_micros("queued_at") / 1e6).alias("at"), F.lit(2.0).alias("delay")))
    return rows.groupBy("domain").agg(F.round(F.sum("wait_sec"), 3).alias("total_wait"), F.round(F.max("wait_sec"), 3).alias("longest_wait"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """HTML made from the documents: a title, a heading, a menu with a link within the site, one out of it and one without an
    address, and the lines as list items and table cells in turn; a script whose text isn't read."""
    safe = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    item = lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("<li class='line odd'>"), safe(x), F.lit("</li>"))).otherwise(F.concat(F.lit("<td class=line>"), safe(x)))
    first = safe(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    menu = "</h1><nav><a href='/courses#top'>Courses</a><a href='https://elsewhere.example/'>Out</a><a>None</a></nav><script>var x = 'BSc 9000';</script><ul>"
    page = F.concat(F.lit("<html><head><title>"), first, F.lit("</title></head><body class='page'><h1 class='top'>"), first, F.lit(menu), F.array_join(F.transform(lines, item), "\n"), F.lit("</ul></body></html>"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "url", page.alias("html"), html.extract()(F.col("url"), page).alias("p"))


@R.query(r"""
    WITH l AS (SELECT doc_id, url, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, trim(coalesce(ls[1], '')) AS title, CASE WHEN url IS NULL THEN [] ELSE ['https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/courses'] END AS links,
           2 + len(ls) // 2 + 2 * ((len(ls) + 1) // 2) AS classes FROM l""")
def extract_structure(spark: SparkSession, d: str) -> DataFrame:
    """Title, links within the site and class names of pages."""
    links = F.transform("p.links", lambda x: F.regexp_replace(x, "^http:", "https:"))
    classes = F.aggregate("p.tag_class_counts", F.lit(0).cast("long"), lambda a, c: a + c["occurrence_count"])
    return _pages(spark, d).select("doc_id", "p.title", links.alias("links"), classes.alias("classes"))


@R.query()
def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is read from pages."""
    return _pages(spark, d).select("doc_id", "p.*")


@R.query(r"""
    WITH x AS (SELECT doc_id, regexp_replace(trim(regexp_replace(coalesce(split_part(text, chr(10), 1), ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]+', ' ', 'g'), ' '),
                   '(?i)^(?:\s*(?:私は|僕は|ぼくは|私が|当方は|i am|i''m|i study at|i studied at|my university is))+\s*', '') AS t FROM documents),
    n AS (SELECT doc_id, coalesce(nullif(regexp_extract(t, '([一-龠々ぁ-んァ-ンA-Za-z0-9・\-\s]{1,80}(?:大学|大学院|短期大学|高等専門学校|専門学校))', 1), ''),
                   nullif(regexp_extract(t, '(?i)([A-Za-z][A-Za-z0-9&''\.\-\s]{1,100}(?:University|College|Institute|School|Polytechnic|Academy))', 1), ''), t) AS n FROM x)
    SELECT doc_id, regexp_replace(trim(regexp_replace(trim(n, ' '), '(?i)^(?:\s*(?:私は|僕は|ぼくは|私が|当方は|i am|i''m|i study at|i studied at|my university is))+\s*', ''), ' '),
                   '^[ ,.;:()\[\]{}"''「」『』]+|[ ,.;:()\[\]{}"''「」『』]+$', '', 'g') AS name FROM n""".replace("\\\\", "\\"))
def university_names(spark: SparkSession, d: str) -> DataFrame:
    """The university that each document's first line names."""
    first = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", html.university_of(first).alias("name"))


@R.query()
def listed_universities(spark: SparkSession, d: str) -> DataFrame:
    """The universities that each document's lines name."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", html.listed_names(F.split("text", "\n")).alias("names"))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.oracles
