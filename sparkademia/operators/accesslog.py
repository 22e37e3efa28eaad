"""Analysis of crawl runs from the server's access log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkademia.functions.text import is_scripted_failure, run_config


@dataclass(frozen=True)
class Run:
    """requests: host, path, recv_ts, send_ts, status, response_type, injected_delay_ms, outcome, client_ip, run_label, line
    (arrival order); domains: host, profile, crawl_delay, robots_status; pages: host, path, status, reachable; workers:
    client_ip, worker_id."""

    requests: DataFrame
    domains: DataFrame
    pages: DataFrame
    workers: DataFrame
    label: str | None = None  # where there are no requests to give it


def kind(path: Column) -> Column:
    return F.when(path == "/robots.txt", "robots").when(path.rlike(r"^/sitemap.*\.xml$"), "sitemap").otherwise("page")


def ok(status: Column, outcome: Column) -> Column:
    return F.coalesce((status < 400) & (outcome == "sent"), F.lit(False))


def known_requests(run: Run) -> DataFrame:
    """Requests to the run's hosts, with their kind and success."""
    hosts = run.domains.select("host").distinct()
    return run.requests.join(hosts, "host", "left_semi").withColumn("kind", kind(F.col("path"))).withColumn("ok", ok(F.col("status"), F.col("outcome")))


def url_results(run: Run) -> DataFrame:
    """One row per fetched page: requests, and whether the last response was a success."""
    pages = known_requests(run).where("kind = 'page'")
    return pages.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("requests"), F.max_by("ok", F.struct("recv_ts", "line")).alias("ok"), F.min("recv_ts").alias("first_ts")
    )


def run_metrics(run: Run) -> DataFrame:
    """One row: label, time span, counts, coverage, throughput, phases, error rates and latencies. A run without requests to
    its hosts has counts of 0 and no times."""
    reqs = known_requests(run)
    page = F.col("kind") == "page"
    sent = page & (F.col("outcome") == "sent")
    ms = (F.col("send_ts") - F.col("recv_ts")) * 1000
    lat, over = F.when(sent, ms), F.when(sent, ms - F.col("injected_delay_ms"))
    with_worker = reqs.join(run.workers.select("client_ip", "worker_id"), "client_ip", "left").withColumn("worker", F.coalesce("worker_id", "client_ip"))
    base = with_worker.agg(
        F.min("recv_ts").alias("start_ts"), F.max("send_ts").alias("end_ts"), F.count(F.lit(1)).alias("requests"),
        F.count_if(page).alias("page_requests"), F.count_if(F.col("kind") == "robots").alias("robots_requests"),
        F.count_if(F.col("kind") == "sitemap").alias("sitemap_requests"), F.min(F.when(page, F.col("recv_ts"))).alias("first_page_ts"),
        F.count_if(page & ~F.col("ok")).alias("failed_requests"),
        F.percentile(lat, F.lit(0.5)).alias("latency_p50"), F.percentile(lat, F.lit(0.95)).alias("latency_p95"), F.max(lat).alias("latency_max"),
        F.percentile(over, F.lit(0.5)).alias("overhead_p50"), F.percentile(over, F.lit(0.95)).alias("overhead_p95"),
        F.countDistinct(F.when(page, F.col("worker"))).alias("workers"),
    )
    expected = run.pages.where(F.col("reachable") == "1").select("host", "path").distinct().withColumn("expected", F.lit(True))
    status = run.pages.groupBy("host", "path").agg(F.first("status").alias("expected_status"))
    urls = url_results(run).join(expected, ["host", "path"], "full_outer").join(status, ["host", "path"], "left")
    fetched = F.col("requests").isNotNull()
    unexpected = fetched & ~F.col("ok") & ~is_scripted_failure(F.coalesce("expected_status", F.lit("404")))
    per_url = urls.agg(
        F.count_if(fetched).alias("urls"), F.count_if(F.col("expected")).alias("expected_urls"),
        F.count_if(fetched & F.col("expected")).alias("covered"), F.count_if(F.col("requests") > 1).alias("retried_urls"),
        F.count_if(fetched & ~F.col("ok")).alias("failed_urls"), F.count_if(unexpected).alias("unexpected_failed_urls"),
    )
    hosts_only = run.domains.select("host").distinct().withColumn("known", F.lit(True))
    undefined = run.requests.join(hosts_only, "host", "left").agg(
        F.count_if(F.col("known").isNull() | (F.col("response_type") == "undefined")).alias("undefined_requests"),
        F.coalesce(F.max("run_label"), F.lit(run.label)).alias("label"),
    )
    # three one-row results side by side
    m = base.withColumn("__j", F.lit(1)).join(per_url.withColumn("__j", F.lit(1)), "__j").join(undefined.withColumn("__j", F.lit(1)), "__j").drop("__j")
    span = F.col("end_ts") - F.col("start_ts")
    crawl = F.col("end_ts") - F.col("first_page_ts")
    rate = lambda a, b: F.when(b > 0, a / b)
    return m.select(
        "label", run_config(F.col("label")).alias("config"), "start_ts", "end_ts", span.alias("total_time_sec"), "requests", "page_requests",
        "robots_requests", "sitemap_requests", "undefined_requests", "urls", "expected_urls", rate(F.col("covered"), F.col("expected_urls")).alias("coverage"),
        (F.col("expected_urls") - F.col("covered")).alias("missing_urls"), "retried_urls", rate(F.col("urls"), span).alias("urls_per_sec"),
        (F.col("first_page_ts") - F.col("start_ts")).alias("seed_phase_sec"), crawl.alias("crawl_phase_sec"), rate(F.col("urls"), crawl).alias("crawl_urls_per_sec"),
        rate(F.col("page_requests"), span).alias("requests_per_sec"), "failed_urls", rate(F.col("failed_urls"), F.col("urls")).alias("url_error_rate"),
        rate(F.col("failed_requests"), F.col("page_requests")).alias("request_error_rate"), "unexpected_failed_urls",
        "latency_p50", "latency_p95", "latency_max", "overhead_p50", "overhead_p95", "workers",
    )


def requests_by_worker(run: Run) -> DataFrame:
    """Page requests of each worker, most first; clients without a worker count under their address."""
    reqs = known_requests(run).where("kind = 'page'").join(run.workers.select("client_ip", "worker_id"), "client_ip", "left")
    return reqs.groupBy(F.coalesce("worker_id", "client_ip").alias("worker")).agg(F.count(F.lit(1)).alias("page_requests")).orderBy(F.desc("page_requests"), "worker")


def missing_urls(run: Run) -> DataFrame:
    """Pages that could be reached but weren't fetched."""
    return run.pages.where(F.col("reachable") == "1").select("host", "path").distinct().join(url_results(run), ["host", "path"], "left_anti")


def crawl_delay(run: Run, tolerance: float = 0.05) -> DataFrame:
    """Per host how well the required delay between fetches was kept. A host counts only if its robots.txt was served and
    asks for a delay. Repeats of a page directly after it are one fetch. The window runs within hosts; a busy host's rows
    are sorted with spilling."""
    pages = known_requests(run).where("kind = 'page'")
    w = Window.partitionBy("host").orderBy("recv_ts", "line")
    rows = pages.select("host", "path", "recv_ts", "client_ip", "line").withColumn("pp", F.lag("path").over(w)).withColumn("pt", F.lag("recv_ts").over(w))
    retry = F.col("pt").isNotNull() & (F.col("path") == F.col("pp"))
    rows = rows.withColumn("retry", F.coalesce(retry, F.lit(False)))
    last = F.last(F.when(~F.col("retry"), F.col("recv_ts")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("gap", F.when(~F.col("retry"), F.col("recv_ts") - last)).withColumn("retry_gap", F.when(F.col("retry"), F.col("recv_ts") - F.col("pt")))
    d = run.domains.select("host", "profile", F.col("crawl_delay").cast("double").alias("delay"), ((F.col("robots_status") == "200") & (F.col("crawl_delay") > 0)).alias("applicable"))
    j = d.join(rows, "host", "left")
    short = F.count_if(F.col("gap") < F.col("delay") - tolerance)
    return j.groupBy("host", "profile", "delay", "applicable").agg(
        F.count("path").alias("page_requests"), F.count("gap").alias("pairs"), F.min("gap").alias("min_interval"),
        F.percentile("gap", F.lit(0.5)).alias("p50_interval"), short.alias("short"), F.count("retry_gap").alias("retry_pairs"),
        F.min("retry_gap").alias("min_retry_interval"), F.countDistinct("client_ip").alias("clients"),
    ).select(
        "host", "profile", F.when(F.col("applicable"), F.col("delay")).alias("required_delay"), "applicable", "page_requests", "pairs", "min_interval",
        "p50_interval", F.when(F.col("applicable"), F.col("short")).alias("violations"), "retry_pairs", "min_retry_interval", "clients",
    )


def crawl_delay_summary(rows: DataFrame) -> DataFrame:
    use = F.col("applicable") & (F.col("pairs") > 0)
    return rows.agg(
        F.count_if(use).alias("domains_checked"), F.count_if(~F.col("applicable")).alias("domains_excluded"),
        F.coalesce(F.sum(F.when(use, F.col("violations"))), F.lit(0)).alias("violations"), F.count_if(use & (F.col("violations") > 0)).alias("domains_with_violations"),
        F.min(F.when(use, F.col("min_interval") - F.col("required_delay"))).alias("min_margin_sec"), F.coalesce(F.sum("retry_pairs"), F.lit(0)).alias("retry_pairs"),
    )


def crawl_delay_table(rows: DataFrame) -> DataFrame:
    """Per required delay: hosts, shortest gap, violations, repeats; hosts without a delay last."""
    some = F.col("pairs") > 0
    return rows.groupBy("required_delay").agg(
        F.countDistinct("host").alias("domains"), F.min(F.when(some, F.col("min_interval"))).alias("min_interval"),
        F.sum(F.when(some, F.col("violations"))).alias("violations"), F.sum("retry_pairs").alias("retry_pairs"),
    ).orderBy(F.col("required_delay").asc_nulls_last())


def resource_usage(samples: DataFrame, start: float | None, end: float | None, slack: float = 5.0) -> DataFrame:
    """Per source file: samples, mean and largest CPU and memory within the run's time, give or take `slack` seconds.
    Files without a sample in it have no row. samples: source, at (timestamp), and the four measures."""
    t = F.unix_micros(F.col("at").cast("timestamp")) / 1e6
    if start is not None and end is not None:
        samples = samples.where(t.between(start - slack, end + slack))
    return samples.groupBy("source").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("system_cpu_percent").alias("cpu_avg"), F.max("system_cpu_percent").alias("cpu_max"),
        F.avg("process_cpu_percent").alias("process_cpu_avg"), F.max("process_cpu_percent").alias("process_cpu_max"),
        F.max("process_rss_mb").alias("rss_max"), F.max("system_memory_percent").alias("memory_max"),
    )


def resource_totals(usage: DataFrame) -> DataFrame:
    """The mean of means and the largest of the largest over all sources."""
    return usage.agg(
        F.avg("cpu_avg").alias("cpu_avg"), F.max("cpu_max").alias("cpu_max"), F.max("rss_max").alias("rss_max"),
        F.avg("process_cpu_avg").alias("process_cpu_avg"), F.max("process_cpu_max").alias("process_cpu_max"),
    )


def compare(metrics: DataFrame, baseline: str) -> DataFrame:
    """Per configuration the median over its runs, sums of failures and violations, and ratios against a baseline.
    metrics: rows of run_metrics with a column violations."""
    by = metrics.groupBy("config").agg(
        F.count(F.lit(1)).alias("runs"), *[F.median(c).alias(c) for c in ("workers", "urls", "coverage", "total_time_sec", "seed_phase_sec", "urls_per_sec", "crawl_urls_per_sec", "latency_p50", "latency_p95", "url_error_rate")],
        F.sum("unexpected_failed_urls").alias("unexpected_failed_urls"), F.sum("violations").alias("violations"),
    )
    base = by.where(F.col("config") == baseline).select(F.col("urls_per_sec").alias("__u"), F.col("workers").alias("__w"), F.lit(1).alias("__j"))
    out = by.withColumn("__j", F.lit(1)).join(base, "__j", "left")
    ratio = F.col("urls_per_sec") / F.nullif(F.col("__u"), F.lit(0.0))
    return out.withColumn("vs_baseline", ratio).withColumn("scale_efficiency", ratio / F.nullif(F.col("workers") / F.col("__w"), F.lit(0.0))).drop("__j", "__u", "__w")


def warnings(metrics: DataFrame) -> DataFrame:
    """(label, warning) for metrics that make a run doubtful. metrics: rows of run_metrics with violations."""
    rules = F.array_compact(
        F.array(
            F.when(F.col("requests") == 0, F.lit("no requests in the access log")),
            F.when(F.col("coverage") < 1, F.concat(F.col("missing_urls").cast("string"), F.lit(" reachable URLs were not fetched"))),
            F.when(F.col("unexpected_failed_urls") > 0, F.concat(F.col("unexpected_failed_urls").cast("string"), F.lit(" URLs failed unexpectedly"))),
            F.when(F.col("undefined_requests") > 0, F.concat(F.col("undefined_requests").cast("string"), F.lit(" requests to unknown hosts or paths"))),
            F.when(F.col("violations") > 0, F.concat(F.col("violations").cast("string"), F.lit(" delay violations"))),
            F.when(F.col("overhead_p95") > 50, F.lit("server overhead p95 above 50 ms")),
        )
    )
    return metrics.select("label", F.explode(rules).alias("warning"))
