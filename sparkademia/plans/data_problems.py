"""Queries of the general data problems (p1, p4, p5, p7) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkademia.operators import grid, hierarchy, skew, units
from sparkademia.session import Workspace, table


def _fees(spark: SparkSession, d: str) -> DataFrame:
    sources = units.pattern_sources(
        table(spark, d, "program_tuition_map"), table(spark, d, "degree_programs"), table(spark, d, "universities")
    )
    return units.normalise_fees(table(spark, d, "tuition_patterns"), table(spark, d, "exchange_rates"), sources)


def p1_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every pattern's fee a month in its own currency and in US dollars, or its place in the review queue."""
    return _fees(spark, d)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.wrong_fees(_fees(spark, d))


def domain_states(spark: SparkSession, d: str) -> DataFrame:
    """Results per domain over crawl_queue_state LEFT JOIN crawl_edges on (domain, run), by eager aggregation."""
    q, e = table(spark, d, "crawl_queue_state"), table(spark, d, "crawl_edges")
    return skew.eager_join_aggregate(
        q,
        e,
        {"domain": F.col("domain"), "run_id": F.col("run_id")},
        {"domain": F.col("child_domain"), "run_id": F.col("run_id")},
        group=["domain"],
        left_aggs={
            "errors": ("count", F.when(F.col("status") == "error", 1)),
            "retries": ("sum", F.col("retry_count").cast("long")),
            "latest": ("max", F.col("updated_at")),
            "earliest": ("min", F.col("queued_at")),
        },
        right_aggs={"deepest_link": ("max", F.col("depth"))},
    )


def p4_domains(spark: SparkSession, d: str) -> DataFrame:
    """Counts, errors and latest times of each domain with the number of links into it and of (row, link) pairs."""
    return domain_states(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The domains with a fiftieth of all rows, from the rolled-up states of the join; these are written once, and the
    total is taken from them."""
    states = Workspace(spark, "domains").write(domain_states(spark, d), "states")
    hot = skew.frequent_keys(states, "left_rows", 1 / 50)
    return hot.where(F.col("domain").isNotNull()).select("domain")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(
        table(spark, d, "resource_samples"),
        "worker_id",
        grid.epoch_seconds(F.col("timestamp")),
        ["process_cpu_percent", "process_rss_mb"],
    )


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    """One row per worker and 30-second slot, empty slots filled and marked."""
    return _grid(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The slots of the grid that the regression filled; the grid is written with their values."""
    filled = Workspace(spark, "grid").write(_grid(spark, d).where("filled"), "filled")
    return filled.where("process_cpu_percent IS NOT NULL AND process_rss_mb IS NOT NULL").select("worker_id", "slot_start")


def p7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, start page and number of descendants of every page of every run."""
    return hierarchy.hierarchy(table(spark, d, "crawl_edges")).drop("lft", "rgt", "further_ranges")


def p7_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The nested-set ranges that hold all descendants of every page of every run."""
    return hierarchy.hierarchy(table(spark, d, "crawl_edges")).select("run_id", "url", "root_url", "lft", "rgt", "further_ranges")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.circles(table(spark, d, "crawl_edges"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_normalised, p4_found, p4_domains, p5_found, p5_grid, p7_found, p7_hierarchy, p7_ranges)}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
            SELECT domain FROM crawl_queue_state WHERE domain IS NOT NULL GROUP BY domain
            HAVING count(*) * 50 >= (SELECT count(*) FROM crawl_queue_state)""",
        "p4_domains": """
            WITH q AS (SELECT domain, run_id, count(*) n, count(*) FILTER (status = 'error') errors,
                              sum(retry_count) retries, max(updated_at) latest, min(queued_at) earliest
                       FROM crawl_queue_state GROUP BY ALL),
                 e AS (SELECT child_domain, run_id, count(*) m, max(depth) deepest FROM crawl_edges GROUP BY ALL)
            SELECT q.domain, sum(n)::BIGINT AS left_rows, coalesce(sum(m), 0)::BIGINT AS right_rows,
                   sum(n * greatest(coalesce(m, 0), 1))::BIGINT AS pairs, sum(errors)::BIGINT AS errors,
                   sum(errors * greatest(coalesce(m, 0), 1))::BIGINT AS errors_joined, sum(retries)::BIGINT AS retries,
                   sum(retries * greatest(coalesce(m, 0), 1))::BIGINT AS retries_joined, max(latest) AS latest,
                   min(earliest) AS earliest, max(deepest) AS deepest_link
            FROM q LEFT JOIN e ON q.domain = e.child_domain AND q.run_id = e.run_id GROUP BY q.domain""",
        "p5_found": r"""
            WITH t AS (SELECT worker_id, trim(timestamp, ' ') AS t FROM resource_samples WHERE worker_id IS NOT NULL AND process_cpu_percent >= 0 AND process_rss_mb >= 0
                          AND NOT isnan(process_cpu_percent) AND NOT isnan(process_rss_mb)),
            c AS (SELECT worker_id, t, regexp_extract(t, '([+-][0-9]{2}):?([0-9]{2})?$', 0) AS zone,
                         regexp_replace(regexp_replace(t, '^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})[T ]+', '\1-\2-\3 '), ' *(Z|UTC|[+-][0-9]{2}:?[0-9]{2})$', '') AS clock FROM t),
            e AS (SELECT worker_id, CASE WHEN regexp_matches(t, '^[0-9]{9,11}$') THEN t::DOUBLE WHEN regexp_matches(t, '^[0-9]{12,14}$') THEN t::DOUBLE / 1000
                         WHEN regexp_matches(t, '^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}[T ]+[0-9]{1,2}:[0-9]{2}') THEN epoch(try_cast(clock AS TIMESTAMP))
                         - CASE WHEN regexp_matches(t, ':[0-9]{2}.*[+-][0-9]{2}:?[0-9]{2}$') THEN (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END) * (zone[2:3]::INT * 3600 + right(zone, 2)::INT * 60) ELSE 0 END END AS s FROM c),
            o AS (SELECT DISTINCT worker_id, (floor(s / 30) * 30)::BIGINT AS slot FROM e WHERE s IS NOT NULL),
            a AS (SELECT worker_id, unnest(range(min(slot), max(slot) + 1, 30)) AS slot_start FROM o GROUP BY worker_id)
            SELECT worker_id, slot_start FROM a ANTI JOIN (SELECT worker_id, slot AS slot_start FROM o) x USING (worker_id, slot_start)""",
        "p7_found": """
            WITH RECURSIVE e AS (SELECT DISTINCT run_id, parent_url p, child_url c FROM crawl_edges),
            r AS (SELECT run_id, p, c FROM e UNION SELECT r.run_id, r.p, e.c FROM r JOIN e ON e.run_id = r.run_id AND e.p = r.c)
            SELECT DISTINCT run_id, p AS url FROM r WHERE p = c""",
        "p7_hierarchy": """
            WITH RECURSIVE e AS (SELECT run_id, parent_url AS p, child_url AS c, min(id) AS o FROM crawl_edges
                                 WHERE run_id IS NOT NULL AND parent_url IS NOT NULL AND child_url IS NOT NULL GROUP BY ALL),
            n AS (SELECT run_id, p AS u FROM e UNION SELECT run_id, c FROM e),
            first AS (SELECT run_id, c AS u, arg_min(p, o) AS up FROM e WHERE p <> c GROUP BY run_id, c),
            k AS (SELECT run_id, u, up FROM first UNION
                  SELECT k.run_id, k.u, f.up FROM k JOIN first f ON f.run_id = k.run_id AND f.u = k.up),
            cut AS (SELECT run_id, u FROM k SEMI JOIN (SELECT run_id, u FROM k WHERE u = up) r USING (run_id, u)
                    GROUP BY run_id, u HAVING min(up) = u),
            f AS (SELECT * FROM first ANTI JOIN cut USING (run_id, u)),
            t AS (SELECT run_id, u, NULL::VARCHAR AS up, u AS root, 0::BIGINT AS depth, [u] AS path FROM n ANTI JOIN f USING (run_id, u)
                  UNION ALL SELECT f.run_id, f.u, f.up, t.root, t.depth + 1, list_append(t.path, f.u)
                  FROM f JOIN t ON t.run_id = f.run_id AND t.u = f.up),
            b AS (SELECT run_id, u, count(*) - 1 AS n FROM (SELECT run_id, unnest(path) AS u FROM t) GROUP BY ALL),
            r AS (SELECT run_id, p, c FROM e UNION SELECT r.run_id, r.p, e.c FROM r JOIN e ON e.run_id = r.run_id AND e.p = r.c),
            a AS (SELECT run_id, p AS u, count(*) FILTER (p <> c) AS n, bool_or(p = c) AS ring FROM r GROUP BY ALL)
            SELECT t.run_id, t.u AS url, t.up AS parent_url, t.root AS root_url, t.depth, b.n AS descendants, t.path,
                   coalesce(a.ring, false) AS on_circle, coalesce(a.n, 0) AS all_descendants
            FROM t JOIN b USING (run_id, u) LEFT JOIN a USING (run_id, u)""",
    }
