"""Crawl frontiers: link expansion, admission, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkademia.operators.hierarchy import climb
from sparkademia.operators.relational import top_per_group
from sparkademia.session import Workspace


def expand(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Children of the frontier's pages, one level deeper. frontier: domain, url, depth; links: url, child."""
    j = frontier.join(links.select("url", "child"), "url")
    return j.select("domain", F.col("child").alias("url"), (F.col("depth") + 1).alias("depth")).groupBy("domain", "url").agg(F.min("depth").alias("depth"))


def admit(tasks: DataFrame, known: DataFrame, max_depth: int, budget: int | None = None) -> DataFrame:
    """The tasks that may be queued: not too deep, not known, each url once, and at most `budget` a domain, shallowest
    first. A task that is rejected takes nothing of the budget."""
    new = tasks.where(F.col("depth") <= max_depth).groupBy("domain", "url").agg(F.min("depth").alias("depth"))
    new = new.join(known.select("domain", "url").distinct(), ["domain", "url"], "left_anti")
    return new if budget is None else top_per_group(new, ["domain"], [F.col("depth"), F.col("url")], budget)


def reachable(pages: DataFrame, links: DataFrame, starts: DataFrame) -> DataFrame:
    """(host, path) of the pages reached from the start pages, following links of pages whose status is 2xx.

    Not level by level: pages with one parent are first gathered under the nearest page above them that is a start, has
    several parents or none, by pointer doubling in about log2(depth) rounds; then the search goes over these pieces only.
    Circles nobody enters stay unfinished in the doubling and aren't reached. pages: host, path, status; links: host,
    path, child; starts: host, path. Repeated rows count once; empty inputs give no rows.
    """
    space = Workspace(pages.sparkSession, "reach")
    node = lambda p: F.xxhash64("host", p)
    known = pages.select("host", "path", node("path").alias("v"), F.col("status").cast("string").rlike("^2[0-9][0-9]$").alias("good")).dropDuplicates(["v"])
    known = space.write(known, "pages")
    steps = links.select(node("path").alias("p"), node("child").alias("c")).where("p <> c").distinct()
    steps = steps.join(known.where("good").select(F.col("v").alias("p")), "p", "left_semi").join(known.select(F.col("v").alias("c")), "c", "left_semi")
    steps = space.write(steps.select("p", "c"), "steps")
    first = space.write(starts.select(node("path").alias("v")).distinct().join(known.select("v"), "v", "left_semi"), "starts")
    parents = steps.groupBy(F.col("c").alias("v")).agg(F.min("p").alias("a"), F.count(F.lit(1)).alias("n"))
    above = known.select("v").join(parents, "v", "left").join(first.withColumn("is_start", F.lit(True)), "v", "left")
    single = (F.col("n") == 1) & F.col("is_start").isNull()
    start = above.select("v", F.when(single, F.col("a")).alias("up"), F.lit(None).cast("long").alias("near"), F.lit(1).cast("long").alias("size"))
    done = space.write(climb(space, start).where("a IS NULL").select("v", "root"), "pieces")
    tops = done.where("v = root").select(F.col("v").alias("c"))
    hops = space.write(steps.join(tops, "c", "left_semi").join(done.select(F.col("v").alias("p"), "root"), "p").select("root", "c").distinct(), "hops")
    new = reached = first
    while new.take(1):
        nxt = new.join(hops, new["v"] == hops["root"]).select(F.col("c").alias("v")).distinct()
        new = space.write(nxt.join(reached, "v", "left_anti"), "new")
        reached = space.write(reached.unionByName(new), "reached")
    inside = done.join(reached.select(F.col("v").alias("root")), "root", "left_semi").select("v")
    return known.join(inside, "v", "left_semi").select("host", "path")


def seed_targets(results: DataFrame, min_hits: int, max_errors: int, max_depth: int, blocked: list[str] | None = None) -> DataFrame:
    """(root, depth): start urls of the results that pass the thresholds; the newest result (highest id) wins a root.

    results: id, source_url, roots, details (arrays), listed, depth, hits, errors."""
    from sparkademia.functions import urls as U

    ok = F.col("listed") & (F.col("hits") >= min_hits) & (F.col("errors") <= max_errors) & (F.col("depth") <= max_depth)
    none = F.array().cast("array<string>")
    roots = U.root_urls(F.coalesce("roots", none), F.coalesce("details", none), F.array("source_url"))
    rows = results.where(ok).select("id", F.greatest(F.lit(1), F.least("depth", F.lit(max_depth))).alias("depth"), F.explode(roots).alias("root"))
    rows = rows.where(~U.is_blocked(U.netloc(F.col("root")), blocked or U.BLOCKED_DOMAINS))
    return rows.groupBy("root").agg(F.max_by("depth", "id").alias("depth"))


def official_domains(hits: DataFrame, n: int = 3) -> DataFrame:
    """(domain, score): the best domains of some search hits. hits: url, score, names (array). Domains count that are
    academic or fit a name; where there are none, all that aren't blocked."""
    from sparkademia.functions import text as X
    from sparkademia.functions import urls as U

    d = U.netloc(F.col("url"))
    rows = hits.select(d.alias("domain"), "score", "names").where((F.col("domain") != "") & ~U.is_blocked(F.col("domain")))
    bonus = X.domain_bonus(F.col("domain"), F.col("names"))
    academic = U.any_of([F.col("domain").endswith(e) for e in X.ACADEMIC_ENDINGS])
    rows = rows.withColumn("academic", academic).withColumn("bonus", bonus).withColumn("fits", F.col("academic") | (F.col("bonus") >= 0.8))
    best = rows.groupBy("domain").agg(
        F.max(F.when(F.col("fits"), F.col("score") + F.col("bonus") + F.when(F.col("academic"), 2.0).otherwise(0.0))).alias("strict"), F.max("score").alias("loose")
    )
    has_strict = best.agg(F.count("strict") > 0).scalar()
    chosen = best.where(~has_strict | F.col("strict").isNotNull()).select("domain", F.coalesce("strict", "loose").alias("score"))
    return chosen.orderBy(F.desc("score"), "domain").limit(n)


def enabled(seeds: DataFrame) -> DataFrame:
    """The seeds that are switched on (enabled = 1), by id."""
    return seeds.where("enabled = 1").orderBy("id")


def cached(results: DataFrame, known: DataFrame) -> DataFrame:
    """The newest result (highest id) of each source that holds any seed, if all its root urls are known: source_url, id,
    roots. Such a source needn't be searched again. results: id, source_url, roots, details (arrays); known: root."""
    from sparkademia.functions import urls as U

    none = F.array().cast("array<string>")
    filled = results.where((F.size(F.coalesce("roots", none)) > 0) | (F.size(F.coalesce("details", none)) > 0))
    newest = filled.groupBy("source_url").agg(F.max_by(F.struct("id", "roots", "details"), "id").alias("r"))
    rows = newest.select("source_url", "r.id", U.root_urls(F.coalesce("r.roots", none), F.coalesce("r.details", none)).alias("roots")).where(F.size("roots") > 0)
    each = rows.select("source_url", F.explode("roots").alias("root"))
    unknown = each.join(known.select("root"), "root", "left_anti").select("source_url").distinct()
    return rows.join(unknown, "source_url", "left_anti")


def assemble(hits: DataFrame, known: DataFrame, official: DataFrame | None = None) -> DataFrame:
    """One row per request: roots (new root urls in the order of the hits), details (listing pages whose root is new),
    listed (whether any hit looks like a list of courses), depth (1 if so, 2 with any hit, else 3), known (root urls that
    are there already, sorted).

    hits: request, place (order), url, course_like; known: root; official: request, domain, where hits must lie on an
    official domain, for the requests that have any. Hits on blocked domains don't count. A request's hits are one search's."""
    from sparkademia.functions import urls as U

    rows = hits.select("request", "place", "url", F.coalesce("course_like", F.lit(False)).alias("course_like"), U.netloc(F.col("url")).alias("domain"), U.root_url(F.col("url")).alias("root"))
    allowed = ~U.is_blocked(F.col("domain"))
    if official is not None:
        some = official.select(F.col("request").alias("__r")).distinct()
        right = official.select(F.col("request").alias("__q"), F.col("domain").alias("__d"), F.lit(True).alias("__ok")).distinct()
        rows = rows.join(some, F.col("request").eqNullSafe(F.col("__r")), "left").join(right, F.col("request").eqNullSafe(F.col("__q")) & (F.col("domain") == F.col("__d")), "left")
        allowed = allowed & (F.col("__r").isNull() | F.col("__ok").isNotNull())
    rows = rows.withColumn("allowed", allowed).join(known.select("root", F.lit(True).alias("is_known")).distinct(), "root", "left")
    has_root, old = F.col("allowed") & (F.col("root") != ""), F.col("is_known").isNotNull()
    first = rows.where(has_root).groupBy("request", "root", "is_known").agg(F.min("place").alias("place"))
    roots = first.groupBy(F.col("request").alias("__of")).agg(
        F.transform(F.sort_array(F.collect_list(F.when(~old, F.struct("place", "root")))), lambda x: x["root"]).alias("roots"),
        F.sort_array(F.collect_list(F.when(old, F.col("root")))).alias("known"),
    )
    per = rows.groupBy("request").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("allowed") & F.col("course_like") & ~old, F.struct("place", "url")))), lambda x: x["url"]).alias("details"),
        F.coalesce(F.bool_or(F.col("allowed") & F.col("course_like")), F.lit(False)).alias("listed"), F.bool_or("allowed").alias("any"),
    )
    none = F.array().cast("array<string>")
    out = per.join(roots, F.col("request").eqNullSafe(F.col("__of")), "left")
    depth = F.when(F.col("listed"), 1).when(F.col("any"), 2).otherwise(3)
    return out.select("request", F.coalesce("roots", none).alias("roots"), "details", "listed", depth.alias("depth"), F.coalesce("known", none).alias("known"))
