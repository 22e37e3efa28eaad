"""Sources, page reading, merges, access-log analysis and streaming state on small fixtures."""

import datetime
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkademia.functions import html, text, urls
from sparkademia.operators import accesslog, frontier, merge, relational, transform
from sparkademia.plans import pipeline
from sparkademia.sources import files, stores
from sparkademia.streaming import queue_log, state

# --- page records -----------------------------------------------------------------------------------------------------

RECORDS = [
    dict(url="https://study.ed.ac.uk/programmes/pg/123-informatics", title="Informatics MSc - Postgraduate | E", country="UK", timestamp="2026-01-02T03:04:05+09:00",
         degrees=[dict(name="Master", price=29400, currency="GBP", course_type="computer_science", is_online=False)]),
    dict(url="https://study.ed.ac.uk/programmes/pg/456-history", title="History MA - Postgraduate", country="UK", timestamp="2026-01-02T03:04:05Z",
         degrees=[dict(name="Master", price=29400, currency="GBP", course_type="humanities")]),
    dict(url="https://study.ed.ac.uk/programmes/pg/789-physics", title="Physics PhD - Postgraduate", country="UK", timestamp="later",
         degrees=[dict(name="PhD", price=5000, currency="GBP", course_type="science")]),
]


@pytest.fixture(scope="module")
def jsonl(tmp_path_factory):
    d = tmp_path_factory.mktemp("records")
    (d / "extracted_records_1.jsonl").write_text("")
    (d / "extracted_records_2.jsonl").write_text("\n\n".join(json.dumps(r) for r in RECORDS) + "\nnot json\n")
    return d


def test_transform(spark, jsonl):
    path = files.latest(spark, f"{jsonl}/extracted_records_*.jsonl")
    assert path.endswith("_2.jsonl")
    records = files.read_jsonl(spark, path)
    b = transform.transform(records)
    assert [(r.id, r.name) for r in b.universities.collect()] == [(1, "University of Edinburgh")]
    p = {r.id: r for r in b.degree_programs.collect()}
    assert len(p) == 3 and {r.quality_flag for r in p.values()} == {"high"} and p[1].program_name == "Informatics MSc"
    assert p[1].last_seen == "2026-01-02 03:04:05" and p[3].last_seen == "later"
    assert sorted(r.degree_level for r in b.tuition_patterns.collect()) == ["Master", "PhD"]
    assert sorted(map(tuple, b.program_tuition_map.collect())) == [(1, 1), (2, 1), (3, 2)]
    empty = transform.transform(records.where("false"))
    assert empty.degree_programs.count() == empty.program_tuition_map.count() == 0
    general = transform.transform(records.withColumn("degrees", F.when(F.col("ordinal") < 0, F.col("degrees"))))
    assert {(r.course_type, r.quality_flag) for r in general.degree_programs.collect()} == {("general", "low")} and general.tuition_patterns.count() == 0


def test_merge_records_and_writer(spark, jsonl, tmp_path):
    r = files.read_jsonl(spark, f"{jsonl}/extracted_records_2.jsonl")
    twice = r.unionByName(r.withColumn("url", F.concat("url", F.lit("/?x=1#y"))).withColumn("ordinal", F.col("ordinal") + 100))
    m = transform.merge_records(twice).collect()
    assert len(m) == 3 and all(len(x.degrees) == 1 for x in m)
    files.write_jsonl(r, str(tmp_path / "out"))
    again = spark.read.json(str(tmp_path / "out"))
    assert again.count() == 3 and {x.degree_count for x in again.collect()} == {1} and {x.domain for x in again.collect()} == {"study.ed.ac.uk"}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("PhD",), ("doctorate",), ("MSc",), ("Postgraduate",), ("undergraduate",), ("",), (None,), ("certificate",), ("mba programme",)], "n string")
    assert [r[0] for r in df.select(text.degree_level(F.col("n"))).collect()] == ["PhD", "PhD", "Master", "Master", "Bachelor", "Other", "Other", "Other", "Bachelor"]
    u = spark.createDataFrame([("https://www.ed-ac.example/x",), ("https://o'neil.example",)], "u string")
    assert [r[0] for r in u.select(urls.university_name(F.col("u"))).collect()] == ["Ed-Ac", "O'Neil"]
    for p, out in (("scholarships", True), ("how-apply", True), ("programmes/postgraduate/informatics-msc", False), ("programmes/postgraduate-research/physics-phd", False)):
        assert spark.range(1).select(urls.is_excluded_page(F.lit(f"https://a.example/{p}"), F.lit(""))).first()[0] is out
    assert spark.range(1).select(text.json_strings(F.lit("['a', 'b']")), text.json_strings(F.lit("oops"))).first()[0:2] == (["a", "b"], [])
    assert spark.range(1).select(text.run_config(F.lit("A-distributed-x2-run1"))).first()[0] == "A-distributed-x2"


# --- pages of HTML ----------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>Master of Science in Data Science - University of Edinburgh</title></head><body>
<h1 class="big title">Data Science</h1><p>Master degree tuition fee: GBP 15000 per year</p><p>PhD programme tuition cost: USD 25000 annually</p>
<p>Bachelor without figures</p><a href="/next?p=2#x" class="pager">Next</a><a href="https://other.example/">Other</a>
<a href="javascript:__doPostBack('grid','Page$2')">&raquo;</a><li>Lund University<script>var University = 1</script></li></body></html>"""


def test_page():
    p = html.read_page("https://a.example/list", PAGE)
    assert p["title"].startswith("Master of Science") and p["heading"] == "Data Science"
    a, b = p["degrees"]
    assert (a["price"], a["currency"], a["tuition_type"], a["normalized_monthly_amount"], a["course_type"]) == (15000, "GBP", "fixed_year", 1250.0, "science")
    assert (b["currency"], b["normalized_monthly_amount"]) == ("USD", 2083.33)
    assert dict(tag_name="h1", class_name="big", occurrence_count=1) in p["tag_class_counts"]
    assert p["links"] == ["https://a.example/next?p=2"] and "Lund University" in p["candidate_lines"]
    page = html.Page(PAGE)
    assert html.pager_actions(page, "https://a.example/list") == [dict(method="get", value="https://a.example/next?p=2#x", argument=""), dict(method="postback", value="grid", argument="Page$2")]
    assert html.page_kind("text/html", page) == "text" and html.page_kind("application/pdf; x", None) == "pdf"
    assert html.course_links("https://a.example", "<a href='/courses/1'><a href='/x'><a href=\"mailto:a@b\">") == ["https://a.example/courses/1"]


def test_extract_udf_and_robots(spark):
    df = spark.createDataFrame([("https://a.example/", PAGE), (None, None), ("x", "<p>broken <b>")], "url string, html string")
    got = df.select(html.extract()(F.col("url"), F.col("html")).alias("p")).select("p.*").collect()
    assert [len(r.degrees) for r in got] == [2, 0, 0]
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.example/c </loc></url></urlset>'
    s = spark.createDataFrame([(xml, "User-agent: *\nDisallow: /no\nSitemap: https://a.example/s.xml"), ("<bad", None)], "xml string, robots string")
    r = s.select(files.parse_sitemap("xml").alias("s"), files.robots_sitemaps("robots").alias("d"), files.can_fetch()(F.col("robots"), F.lit("https://a.example/no/x")).alias("ok")).collect()
    assert r[0].s.pages == ["https://a.example/c"] and r[0].d == ["https://a.example/s.xml"] and r[0].ok is False and r[1].ok is True and r[1].s.pages == []


# --- merges and shapes ------------------------------------------------------------------------------------------------


def test_upsert_rules(spark):
    s = "id int, k string, a string, b string, n int"
    old = spark.createDataFrame([(1, "x", "1", "keep", 0), (2, None, "1", "", 0)], s)
    new = spark.createDataFrame([(7, "x", "2", "", 1), (8, "y", "3", "q", 2), (9, "y", "4", None, 3), (10, None, "5", "r", 4)], s)
    out = merge.upsert(old, new, merge.MergeRule(keys=("k",), update=("a",), fill=("b",), keep="last"), "n", "id")
    assert sorted(((r.id, r.k, r.a, r.b) for r in out.collect()), key=str) == sorted([(1, "x", "2", "keep"), (2, None, "5", "r"), (3, "y", "4", None)], key=str)
    open_ = merge.upsert(old, new, merge.MergeRule(keys=("k",), update=("a",), null_keys="append"), "n")
    assert open_.count() == 4
    assert merge.upsert(old.limit(0), new, merge.MergeRule(keys=("k",)), "n").count() == 3


def test_numbers_and_context(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = relational.with_row_numbers(df, ["x"], "n").collect()
    assert all(r.n == r.x + 1 for r in got)
    assert relational.with_row_numbers(df.limit(0), ["x"], "n").count() == 0
    c = spark.createDataFrame([(["a", "b", "c", "d", "e", "f"],)], "l array<string>").select(relational.neighbours(F.col("l"), 2, 1)).first()[0]
    assert c == ["a b", "a b c", "a b c d", "b c d e", "c d e f", "d e f"]


def test_seed_targets(spark):
    s = "id int, source_url string, roots array<string>, details array<string>, listed boolean, depth int, hits int, errors int"
    rows = [(1, "https://example.edu/list", ["https://example.edu"], ["https://example.edu/programmes"], True, 1, 12, 0), (2, "https://weak.example.edu", [], [], False, 3, 1, 3),
            (3, "https://zoominfo.com", ["https://zoominfo.com"], ["https://m.facebook.com/x"], True, 1, 20, 0)]
    got = frontier.seed_targets(spark.createDataFrame(rows, s), 8, 1, 2).collect()
    assert [tuple(r) for r in got] == [("https://example.edu", 1)]


# --- access log -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("A-distributed-x2-run1")
    t0, h = 1800000000.0, ".bench.internal"
    log = [(0.0, "a", "/robots.txt", 200, "ok", 1), (0.1, "a", "/", 200, "fast", 1), (1.1, "a", "/p1", 200, "fast", 2), (2.1, "a", "/p2", 500, "error_500", 1), (2.15, "a", "/p2", 500, "error_500", 1), (3.08, "a", "/p3", 200, "fast", 2),
           (4.1, "a", "/p4", None, "fast", 1), (0.2, "b", "/", 200, "fast", 1), (1.0, "b", "/p1", 200, "fast", 1), (0.3, "c", "/", 200, "fast", 1), (0.35, "c", "/p1", 200, "fast", 1), (0.4, "unknown", "/", 404, "undefined", 1)]
    lines = [dict(recv_ts=t0 + t, send_ts=t0 + t + 0.01, host=x + h, path=p, client_ip=f"10.0.0.{c}", status=s, response_type=k, injected_delay_ms=10, outcome="sent" if s else "client_disconnected", run_label="A-distributed-x2-run1") for t, x, p, s, k, c in log]
    (d / "access.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (d / "domains.csv").write_text(f"host,profile,crawl_delay,robots_status\na{h},failure,1,200\nb{h},normal,2,200\nc{h},robots_error,1,404\n")
    pages = [("a", p, 500 if p == "/p2" else 200) for p in ("/", "/p1", "/p2", "/p3", "/p4", "/p5")] + [(x, p, 200) for x in "bc" for p in ("/", "/p1")]
    (d / "pages.csv").write_text("host,path,status,reachable\n" + "".join(f"{x}{h},{p},{s},1\n" for x, p, s in pages))
    (d / "workers.csv").write_text("client_ip,worker_id\n10.0.0.1,w1\n10.0.0.2,w2\n")
    r = d / "resources"
    r.mkdir()
    head = "timestamp,elapsed_sec,process_cpu_percent,process_rss_mb,system_cpu_percent,system_memory_percent\n"
    at = lambda s: pd.Timestamp(t0 + s, unit="s").strftime("%Y-%m-%d %H:%M:%S")
    (r / "worker-1.csv").write_text(head + f"{at(0)},0,10,100,20,50\n{at(4)},4,10,150,40,50\n{at(500)},9,10,900,99,50\n")
    (r / "worker-2.csv").write_text(head + f"{at(1)},0,10,200,60,50\n")
    (r / "old.csv").write_text(head + f"{at(9000)},0,10,999,90,50\n")
    return str(d)


def test_run_metrics(spark, run):
    r = files.read_run(spark, run)
    m = accesslog.run_metrics(r).first()
    assert (m.config, m.urls, m.page_requests, m.expected_urls, m.missing_urls, m.retried_urls, m.failed_urls) == ("A-distributed-x2", 9, 10, 10, 1, 1, 2)
    assert (m.unexpected_failed_urls, m.undefined_requests, m.workers) == (1, 1, 2) and abs(m.total_time_sec - 4.11) < 1e-6 and abs(m.urls_per_sec - 9 / 4.11) < 1e-6
    assert [tuple(x) for x in accesslog.requests_by_worker(r).collect()] == [("w1", 8), ("w2", 2)]
    assert [x.path for x in accesslog.missing_urls(r).collect()] == ["/p5"]
    d = {x.host[0]: x for x in accesslog.crawl_delay(r).collect()}
    assert (d["a"].violations, d["a"].retry_pairs, d["a"].pairs, d["a"].clients) == (0, 1, 4, 2) and abs(d["a"].min_interval - 0.98) < 1e-6 and abs(d["a"].min_retry_interval - 0.05) < 1e-6
    assert d["b"].violations == 1 and d["c"].violations is None and not d["c"].applicable
    s = accesslog.crawl_delay_summary(accesslog.crawl_delay(r)).first()
    assert (s.violations, s.domains_excluded) == (1, 1)
    assert [x.required_delay for x in accesslog.crawl_delay_table(accesslog.crawl_delay(r)).collect()] == [1.0, 2.0, None]
    both = accesslog.run_metrics(r).withColumn("violations", F.lit(1).cast("long"))
    c = accesslog.compare(both.unionByName(both.withColumn("config", F.lit("base")).withColumn("urls_per_sec", F.lit(1.0)).withColumn("workers", F.lit(1).cast("long"))), "base")
    x = {y.config: y for y in c.collect()}["A-distributed-x2"]
    assert abs(x.vs_baseline - 9 / 4.11) < 1e-6 and abs(x.scale_efficiency - 9 / 4.11 / 2) < 1e-6
    assert accesslog.warnings(both).count() == 4
    assert files.markdown(accesslog.requests_by_worker(r)).splitlines()[2] == "| w1 | 8 |"


def test_resources(spark, run):
    m = accesslog.run_metrics(files.read_run(spark, run)).first()
    u = accesslog.resource_usage(files.read_resources(spark, run), m.start_ts, m.end_ts)
    got = {r.source: r for r in u.collect()}
    assert set(got) == {"worker-1", "worker-2"} and (got["worker-1"].samples, got["worker-1"].cpu_avg) == (2, 30.0)
    t = accesslog.resource_totals(u).first()
    assert (t.cpu_avg, t.cpu_max, t.rss_max) == (45.0, 60.0, 200.0)


def test_gate_files_and_copies(spark, tmp_path):
    (tmp_path / "g.csv").write_text('﻿source_url,hit_count,errors\nhttps://a.example,3,"[""a\nb""]"\n', encoding="utf-8")
    r = files.read_gate_csv(spark, str(tmp_path / "g.csv")).first()
    assert (r.source_url, r.hit_count, r.root_seed_urls) == ("https://a.example", "3", None) and "\n" in r.errors
    df = spark.range(5)
    stores.copy_store({"t": df}, str(tmp_path / "s"))
    assert [tuple(x) for x in stores.verify_store({"t": df}, spark, str(tmp_path / "s")).collect()] == [("t", 5, 5, True)]
    stores.export_csv({"t": df.select("id", (F.col("id") > 2).alias("b"))}, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c/t")).where("b = '1'").count() == 2


# --- streams ----------------------------------------------------------------------------------------------------------


def test_slots():
    assert state.next_slots([0, 0, 0], [2, 2, 2], None) == ([0, 2, 4], 6) and state.next_slots([5, 6], [0, 0], 9) == ([5, 6], 9)
    assert state.completed(None, 10, 2) == 12 and state.completed(20, 10, 2) == 20 and state.completed(3, 10, 0) == 3
    assert queue_log.is_finished([3, 0, 0]) and not queue_log.is_finished([0, 2, 0]) and not queue_log.is_finished([0])
    p = [dict(numInputRows=5, timestamp=0), dict(numInputRows=0, timestamp=950)]
    assert queue_log.is_stalled(p, 3, 900) and not queue_log.is_stalled(p, 0, 900) and not queue_log.is_stalled(p, 3, 1000)


def test_slots_of_a_domain_in_several_chunks(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", f"u{i:03d}", float(i * 37 % 200)) for i in range(200)] + [("b", f"u{i}", float(9 - i)) for i in range(9)]
    req = spark.createDataFrame(rows, "domain string, url string, at double").withColumns({"kind": F.lit("reserve"), "delay": F.lit(2.0)})
    req.coalesce(1).write.parquet(src)
    out, size = str(tmp_path / "out"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "10")
    try:
        slots = state.reserve_slots(spark.readStream.schema(req.schema).parquet(src), None)
        q = slots.writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c"))
        q.trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(size, before)
    got = {(r.domain, r.url): r.start for r in spark.read.parquet(out).collect()}
    assert got == {(r.domain, r.url): r.start for r in state.reserve_slots_batch(req).collect()}


def test_a_replayed_batch_counts_once(spark, tmp_path, monkeypatch):
    row = dict(run_id=1, url="u", domain="d", at=datetime.datetime(2026, 1, 1))
    from sparkademia import schemas

    names = schemas.QUEUE_EVENT.names
    make = lambda *rows: spark.createDataFrame([tuple((row | r).get(n) for n in names) for r in rows], schemas.QUEUE_EVENT)
    tag = dict(kind="tag", tag_name="h1", course_type="law", keyword="law", count=2, score=10)
    first = make(dict(kind="state", status="pending"), tag, dict(kind="attempt", ok=False), dict(kind="edge", parent_url="p", source="link"), dict(kind="class", tag_name="p", class_name="c", count=1))
    t = queue_log.LogTables(str(tmp_path / "log"))
    queue_log.apply_batch(first, t, 0)
    real, calls = queue_log._merge, []

    def breaks(spark, t, name, *rest):
        calls.append(name)
        if name == "class_counts":
            raise RuntimeError("executor lost")
        real(spark, t, name, *rest)

    monkeypatch.setattr(queue_log, "_merge", breaks)
    with pytest.raises(RuntimeError):
        queue_log.apply_batch(first, t, 1)
    monkeypatch.setattr(queue_log, "_merge", real)
    for _ in range(2):
        queue_log.apply_batch(first, t, 1)
    assert [r["count"] for r in t.read(spark, "tag_scores").collect()] == [4] and [r["count"] for r in t.read(spark, "class_counts").collect()] == [2]
    assert t.read(spark, "attempts").count() == 2 and t.read(spark, "edges").count() == 1 and "class_counts" in calls


def test_a_broken_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.swap(spark.range(3), path)
    boom = F.udf(lambda x: 1 // 0, "int")
    with pytest.raises(Exception):
        merge.swap(spark.range(5).select(boom("id")), path)
    assert merge.current(spark, path).count() == 3
    for n in (4, 5):
        merge.swap(spark.range(n), path)
    assert merge.current(spark, path).count() == 5 and len(merge.versions(spark, path)) == 2


def test_tasks_are_retried_and_then_dead(spark, tmp_path):
    root, names = str(tmp_path / "q"), "url string"
    handle = lambda df: df.withColumn("ok", (F.col("url") == "good") | ((F.col("url") == "late") & (F.col("receives") >= 3)))
    sink = queue_log.retried(spark.createDataFrame([], names), handle, root, most=3)
    for n, urls in enumerate([["good", "late", "bad"], [], [], []]):
        for _ in range(2):  # each batch comes twice
            sink(spark.createDataFrame([(u,) for u in urls], names), n)
    done = {(r.url, r.receives) for r in spark.read.parquet(f"{root}/done").collect()}
    assert done == {("good", 1), ("late", 3)} and [r.url for r in spark.read.parquet(f"{root}/dead").collect()] == ["bad"]
    assert merge.current(spark, f"{root}/waiting").count() == 0


def test_runs_start_and_finish(spark):
    runs = spark.createDataFrame([(1, None, None, "running", 3, "old")], "id long, started_at timestamp, finished_at timestamp, status string, root_seed_count int, notes string")
    new = spark.createDataFrame([(datetime.datetime(2026, 1, 1), 5, "x")], "started_at timestamp, root_seed_count int, notes string")
    end = spark.createDataFrame([(1, "done", datetime.datetime(2026, 1, 2), ""), (9, "done", None, "")], "id long, status string, finished_at timestamp, notes string")
    out = {r.id: r for r in merge.run_finished(merge.run_started(runs, new), end).collect()}
    assert (out[1].status, out[1].notes, out[2].status, out[2].root_seed_count) == ("done", "old", "running", 5) and set(out) == {1, 2}


def test_courses_per_run(spark):
    runs = spark.createDataFrame([(1,), (2,)], "id long")
    q = spark.createDataFrame([(1, "a", "done"), (1, "a", "done"), (1, "b", "error"), (1, None, "done"), (2, "c", "done")], "run_id long, url string, status string")
    p = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b"), (13, None)], "id int, source_url string")
    assert {(r.run_id, r.courses) for r in relational.courses_per_run(runs, q, p).collect()} == {(1, 2), (2, 0)}


def test_names_of_universities(spark):
    df = spark.createDataFrame([(["I study at Lund University.", "lund university", ""], ["x"]), ([], ["We like Foo College", "nothing"])], "n array<string>, l array<string>")
    assert [r.x for r in df.select(html.clean_names(F.col("n"), F.col("l")).alias("x")).collect()] == [["Lund University"], ["We like Foo College"]]
    one = lambda t: spark.range(1).select(html.university_of(F.lit(t)).alias("x")).first().x
    assert one("私は東京大学です") == "東京大学" and one(" I am  I study at  Lund\u3000University ") == "Lund University" and one("(plain)") == "plain"
    lines = ["東京大学｜入試案内", "University of Testing - courses", "Admissions | Home", "The Lund University: fees", "大阪大学院 東京大学"]
    got = spark.range(1).select(html.listed_names(F.array(*map(F.lit, lines))).alias("x")).first().x
    assert got[0] == "東京大学" and "University of Testing" in got and "The Lund University" in got and "大阪大学院" in got and len(got) == len(set(got))
    assert spark.range(1).select(html.listed_names(F.array().cast("array<string>")).alias("x")).first().x == []


def test_page_signals_of_a_long_page(spark):
    page = "x" * 60_000 + "<form>search</form> programmes courses admissions degree"
    df = spark.createDataFrame([("https://a.edu/", "", "", page)], "u string, t string, s string, h string")
    r = df.select(text.page_signals(*[F.col(c) for c in "utsh"]).alias("p")).first().p
    assert r.search_form and r.course_list and r.bonus == 4.0


def test_degree_level_stands_anywhere_in_a_line(spark, tmp_path):
    line = "Fees for the coming academic year, full-time: £9250 MSc Informatics"
    docs = spark.createDataFrame([(1, "https://a.edu/x", "Informatics\n" + line, datetime.datetime(2026, 1, 5))], "doc_id long, url string, text string, fetched_at timestamp")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    patterns = pipeline.transform_patterns(spark, str(tmp_path)).collect()
    assert [(r.degree_level, r.amount, r.currency) for r in patterns] == [("Master", 9250, "GBP")]


def test_task_stream_first_seen(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    day = 86400
    rows = [dict(k="a", t=0), dict(k="a", t=5), dict(k="b", t=6), dict(k="a", t=31 * day), dict(k="a", t=32 * day), dict(k=None, t=1)]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    s = spark.readStream.schema("k string, t long").json(str(src)).withColumn("at", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    out = str(tmp_path / "out")
    q = state.first_seen(s, "k", "at").writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c"))
    q.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.k, r.t) for r in spark.read.parquet(out).collect()) == [("a", 0), ("a", 31 * day), ("b", 6)]


def _first_seen(spark, tmp_path, batches, schema, key="k", ttl_sec=5 * 86400):
    """First sights of batches that arrive one after another, and the stream's progress."""
    src = tmp_path / "in"
    src.mkdir()
    for n, rows in enumerate(batches):
        (src / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(src / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)).withColumn("at", F.timestamp_seconds("t"))
    out = str(tmp_path / "out")
    q = state.first_seen(s, key, "at", ttl_sec).writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c"))
    q = q.trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.read.parquet(out), [json.loads(p.json)["stateOperators"][0] for p in q.recentProgress]


def test_first_sights_share_states(spark, tmp_path):
    rows = [dict(k=f"https://a.example/{n % 30_000}", t=1_700_000_000 + n // 30_000) for n in range(45_000)]
    got, progress = _first_seen(spark, tmp_path, [rows], "k string, t long")
    assert got.count() == 30_000 and got.where("t <> 1700000000").count() == 0
    assert max(p["numRowsUpdated"] for p in progress) <= 4096  # not a call of Python for each key


@pytest.mark.parametrize("kind", ["string", "int", "date", "decimal(9,2)", "double", "timestamp", "array<int>"])
def test_first_sights_over_batches(spark, tmp_path, kind):
    rng, day, start, ttl = random.Random(5), 86400, 1_700_000_000, 5 * 86400
    value = {"date": lambda n: f"2026-01-{n + 1:02}", "timestamp": lambda n: f"2026-01-{n + 1:02}T00:00:00.{n:03}Z", "array<int>": lambda n: [n, 0]}.get(kind, lambda n: n)
    batches = [[dict(n=n, k=None if n == 28 else value(n), t=start + rng.randrange(6 * i * day, (6 * i + 8) * day)) for n in rng.choices(range(29), k=150)] for i in range(4)]
    batches.append([dict(n=0, k=value(0), t=start + 90 * day)])
    want, since = [], {}
    for b in batches:
        for r in sorted(b, key=lambda r: r["t"]):
            if r["n"] != 28 and (r["n"] not in since or r["t"] >= since[r["n"]] + ttl):
                since[r["n"]] = r["t"]
                want.append((r["n"], r["t"]))
    got, progress = _first_seen(spark, tmp_path, batches, f"n int, k {kind}, t long")
    assert sorted((r.n, r.t) for r in got.collect()) == sorted(want) and len(want) > 28 * 4
    assert progress[-1]["numRowsTotal"] == 1  # only the last batch's key is alive


@pytest.mark.parametrize("failures_only", [False, True])
def test_queue_log(spark, tmp_path, failures_only):
    src = tmp_path / "in"
    src.mkdir()
    e = lambda kind, at, **x: json.dumps(dict(kind=kind, run_id=1, url="u", domain="d", at=f"2026-01-01T00:00:0{at}Z") | x)
    t = queue_log.LogTables(str(tmp_path / "log"), failures_only)
    for n, lines in enumerate([
        [e("state", 1, status="pending", fetch_method="httpx"), e("state", 2, status="processing"), e("tag", 1, tag_name="h1", course_type="law", keyword="law", count=2, score=10), e("attempt", 2, ok=False, error_type="x"), e("edge", 1, parent_url="p", source="link")],
        [e("state", 3, status="error", fetch_method=""), e("tag", 3, tag_name="h1", course_type="law", keyword="law", count=1, score=5), e("edge", 3, parent_url="p", source="link"), e("attempt", 3, ok=True)],
    ]):
        (src / f"{n}.json").write_text("\n".join(lines))
        from sparkademia import schemas

        events = spark.readStream.schema(schemas.QUEUE_EVENT).json(str(src))
        queue_log.start(events, t, str(tmp_path / "c")).awaitTermination(120)
    s = t.read(spark, "queue_state").collect()
    assert [(r.status, r.fetch_method) for r in s] == [("error", None if failures_only else "httpx")] or failures_only and s[0].status == "error"
    assert [(r["count"], r.score) for r in t.read(spark, "tag_scores").collect()] == [(3, 15)]
    if failures_only:
        assert t.read(spark, "failures").count() == 1 and t.read(spark, "edges") is None
    else:
        assert t.read(spark, "attempts").count() == 2 and t.read(spark, "edges").count() == 1
        assert sorted(r.attempt_no for r in queue_log.numbered_attempts(t.read(spark, "attempts")).collect()) == [1, 2]
