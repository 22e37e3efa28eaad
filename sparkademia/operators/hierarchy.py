"""Parent-child links of unknown depth to hierarchies: nested sets, the descendants that links beyond the tree add, circles.

Subtree sizes are summed upward and preorder ranges allocated downward by pointer doubling, in about log2(depth) rounds
each and over pages that have children only; pages that the upward pass leaves unprocessed lie on or under circles of
parent links. Every other test of who is above whom is a comparison of nested-set ranges. Each round is written to the
shared folder, so lineage stays short and executors may be lost, and replaces the one before it.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkademia.session import Workspace


@dataclass
class Forest:
    """One parent per page, with what the links beyond that add. Pages are named by a 64-bit hash of run and url.

    pages    v, run, url: once per link, not distinct
    inner    pages with children: v, up (parent), root, depth, near (nearest ancestor that a further link leads to), size
    leaves   pages with a parent and without children: v, up
    extra    p, c: links that aren't parent links
    loops    v: pages that link to themselves
    """

    space: Workspace
    pages: DataFrame
    inner: DataFrame
    leaves: DataFrame
    extra: DataFrame
    loops: DataFrame


def climb(space: Workspace, start: DataFrame) -> DataFrame:
    """Root, depth, nearest head and subtree size by pointer doubling: v, up, a, root, depth, near, size, written.

    start: v, up, near, size (the page and its children that have none). After round k a page points 2^k levels up, and
    its size covers the pages less than 2^k below it. A round in which no page finishes ends it: depths have no gaps, so
    nobody deeper can finish either; pages whose `a` isn't null then lie on circles of parent links or below one.
    """
    top = F.col("up").isNull()
    state = space.write(
        start.select(
            "v", "up", F.col("up").alias("a"), F.when(top, F.col("v")).alias("root"), F.when(top, 0).otherwise(1).cast("int").alias("depth"), "near", "size"
        ),
        "state",
    )
    left, before = state.where("a IS NOT NULL").count(), -1
    while left and left != before:
        todo, done = state.where("a IS NOT NULL"), state.where("a IS NULL")
        above = state.select(F.col("v").alias("at"), F.col("a").alias("a2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("near").alias("near2"))
        moved = todo.join(above, F.col("a") == F.col("at")).select(
            "v", "up", F.col("a2").alias("a"), F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth"), F.coalesce("near", "near2").alias("near"), "size"
        )
        more = todo.groupBy(F.col("a").alias("at")).agg(F.sum("size").alias("more"))
        grown = done.unionByName(moved).join(more, F.col("v") == F.col("at"), "left")
        new = space.write(grown.select("v", "up", "a", "root", "depth", "near", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "state")
        space.drop(state)
        state, before = new, left
        left = state.where("a IS NOT NULL").count()
    return state


def _rings(space: Workspace, stuck: DataFrame, pages: DataFrame) -> DataFrame:
    """The page with the lowest url of each circle of parent links. stuck: v, up, a (an ancestor some levels up) of
    unprocessed pages."""
    direct = stuck.select("v", F.col("up").alias("a"))
    image = stuck.select("v", "a")
    while True:  # once the parents of the targets are as many as the targets, these are the circles themselves
        ring = space.write(image.select(F.col("a").alias("v")).distinct(), "ring")
        parents = direct.join(ring, "v", "left_semi")
        if parents.select("a").distinct().count() == ring.count():
            break
        image = space.write(image.alias("s").join(image.alias("t"), F.col("s.a") == F.col("t.v")).select("s.v", F.col("t.a").alias("a")), "image")
    named = pages.join(ring, "v", "left_semi").select("v", F.struct("url", "v").alias("low")).distinct()
    circle = space.write(parents.join(named, "v"), "circle")
    while True:  # the lowest page within 2^k steps, until that changes nowhere
        c = circle.alias("s").join(circle.alias("t"), F.col("s.a") == F.col("t.v"))
        new = space.write(c.select("s.v", F.col("t.a").alias("a"), F.least("s.low", "t.low").alias("low"), (F.col("t.low") < F.col("s.low")).alias("lower")), "circle")
        circle = new.select("v", "a", "low")
        if new.where("lower").isEmpty():
            return circle.where("v = low.v").select("v")


def build_forest(edges: DataFrame, run: str = "run_id", parent: str = "parent_url", child: str = "child_url", order: str = "id") -> Forest:
    """The forest of a table of links: of a page's parents the one with the lowest `order` (then lowest hash) counts, the
    other links are kept apart.

    Links without run, parent or child are left out; repeated links count once; a link of a page to itself makes no
    parent. Each circle of parent links, which the upward pass reveals, is opened at its page with the lowest url, whose
    parent link joins the further links.
    """
    space = Workspace(edges.sparkSession, "hierarchy")
    rows = edges.where(F.col(run).isNotNull() & F.col(parent).isNotNull() & F.col(child).isNotNull())
    node = lambda u: F.xxhash64(F.col(run), F.col(u))
    both = rows.select(F.explode(F.array(*[F.struct(node(u).alias("v"), F.col(run).alias("run"), F.col(u).alias("url")) for u in (parent, child)])).alias("x"))
    loops = rows.where(F.col(parent) == F.col(child)).select(node(child).alias("v")).distinct()
    hashed = rows.select(node(parent).alias("p"), node(child).alias("c"), F.col(order).alias("o")).where("p <> c")
    links = space.write(hashed.groupBy("p", "c").agg(F.min("o").alias("o")), "links")
    seen = space.write(links.groupBy(F.col("c").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("up")), "seen")
    many = space.write(links.join(seen.where("n > 1").select(F.col("v").alias("c")), "c", "left_semi"), "many")
    best = many.groupBy("c").agg(F.min(F.struct(F.col("o").isNull().alias("none"), "o", "p")).getField("p").alias("up"))
    best = space.write(best, "best")
    parents = seen.where("n = 1").select("v", "up").unionByName(best.select(F.col("c").alias("v"), "up"))
    extra = space.write(many.join(best, "c").where("p <> up").select("p", "c"), "extra")
    kids = parents.groupBy(F.col("up").alias("k")).agg(F.lit(True).alias("has"))
    tree = space.write(parents.join(kids, F.col("v") == F.col("k"), "full_outer").select(F.coalesce("v", "k").alias("v"), "up", F.coalesce("has", F.lit(False)).alias("has")), "tree")
    for old in (links, seen, many, best):
        space.drop(old)
    leaves = tree.where("NOT has").select("v", "up")
    # pages that are only the parents of further links stand alone
    alone = extra.select(F.col("p").alias("v")).distinct().join(tree.select("v"), "v", "left_anti").select("v", F.lit(None).cast("long").alias("up"))
    counts = leaves.groupBy(F.col("up").alias("k")).agg(F.count(F.lit(1)).alias("leaves"))
    inner = tree.where("has").select("v", "up").unionByName(alone).join(counts, F.col("v") == F.col("k"), "left")
    inner = inner.select("v", "up", (1 + F.coalesce("leaves", F.lit(0))).alias("size"))

    def near(rows: DataFrame, extra: DataFrame) -> DataFrame:
        heads = extra.select(F.col("c").alias("h")).distinct()
        return rows.join(heads, F.col("up") == F.col("h"), "left").select("v", "up", F.col("h").alias("near"), "size")

    state = climb(space, near(inner, extra))
    stuck = state.where("a IS NOT NULL")
    if not stuck.isEmpty():
        cut = space.write(_rings(space, stuck, both.select("x.*")), "cut")
        opened = stuck.join(cut, "v", "left_semi").select(F.col("up").alias("p"), F.col("v").alias("c"))
        extra = space.write(extra.unionByName(opened), "extra")
        again = inner.join(stuck.select("v"), "v", "left_semi").join(cut.select(F.col("v").alias("x")), F.col("v") == F.col("x"), "left")
        again = again.select("v", F.when(F.col("x").isNull(), F.col("up")).alias("up"), "size")
        state = state.where("a IS NULL").unionByName(climb(space, near(again, extra)))
    return Forest(space, both.select("x.*"), state.drop("a"), leaves, extra, loops)


def _prefix(rows: DataFrame, group: str, part, order: list, value: str, name: str, ties: bool = False) -> DataFrame:
    """rows with the sum of `value` over the rows before each in its group (with `ties`, including it and those that tie),
    taken within parts of a group and over the parts' totals, so that no task holds a whole group. `part` must rise with
    `order`, or the order be free."""
    rows = rows.withColumn("__part", part)
    totals = rows.groupBy(group, "__part").agg(F.sum(value).alias("__t"))
    w = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, "__part", F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__t"))
    w = Window.partitionBy(group, "__part").orderBy(*order)
    w = w.rangeBetween(Window.unboundedPreceding, 0) if ties else w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return rows.join(totals, [group, "__part"]).withColumn(name, F.col("__in") + F.col("__t")).drop("__part", "__in", "__t")


def nested_sets(forest: Forest, inner: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The pages of `inner` (whole trees) with their nested-set ranges: v, up, root, depth, near, size, lft, rgt; with names
    (v, url) also path, the urls from the root down.

    Siblings get their ranges by prefix sums of subtree sizes, in about as many parts as the root of the number of pages;
    children without children come after those that have some. The offsets are then summed downward by doubling; a round
    writes only the pages that it moved.
    """
    space = forest.space
    siblings = inner.where("up IS NOT NULL").select("v", "up", "size")
    parts = max(1, isqrt(siblings.count()) // 8)
    siblings = _prefix(siblings, "up", F.pmod(F.shiftright("v", 20), F.lit(parts)).cast("int"), ["v"], "size", "before")
    offsets = inner.where("up IS NULL").select("v", F.lit(0).cast("long").alias("off")).unionByName(siblings.select("v", (F.col("before") + 1).alias("off")))
    at = inner.select("v", F.col("up").alias("a")).join(offsets, "v")
    if names is not None:
        at = at.join(names.select("v", F.array("url").alias("path")), "v")
    path = ["path"] if names is not None else []
    moved, final = space.write(at, "offset"), []
    while not (todo := moved.where("a IS NOT NULL")).isEmpty():
        final.append(moved.where("a IS NULL"))
        every = moved
        for f in final[:-1]:
            every = every.unionByName(f)
        above = every.select(F.col("v").alias("at"), F.col("a").alias("a2"), F.col("off").alias("off2"), *[F.col(c).alias("path2") for c in path])
        step = todo.join(above, F.col("a") == F.col("at")).select("v", F.col("a2").alias("a"), (F.col("off") + F.col("off2")).alias("off"), *[F.concat("path2", c).alias(c) for c in path])
        moved = space.write(step, "offset")
    out = moved
    for f in final:
        out = out.unionByName(f)
    out = inner.join(out.select("v", "off", *path), "v")
    return out.withColumns({"lft": F.col("off") + 1, "rgt": F.col("off") + F.col("size")}).drop("off")


def _with_leaves(forest: Forest, leaves: DataFrame, at: DataFrame) -> DataFrame:
    """(v, up, root, depth, near, size, lft, rgt) of pages without children, at the end of their parents' ranges. at: their
    parents' nested sets, whose other columns come along as up_..."""
    heads = forest.extra.select(F.col("c").alias("h")).distinct()
    parts = max(1, isqrt(leaves.count()) // 8)
    rows = _prefix(leaves.withColumn("one", F.lit(1)), "up", F.pmod(F.shiftright("v", 20), F.lit(parts)).cast("int"), ["v"], "one", "rank")
    kept = [c for c in at.columns if c == "path"]
    above = at.select(F.col("v").alias("at"), "root", F.col("depth").alias("d"), F.col("near").alias("n"), "rgt", *kept)
    rows = rows.join(above, F.col("up") == F.col("at")).join(heads, F.col("up") == F.col("h"), "left")
    place = (F.col("rgt") - F.col("rank")).alias("lft")
    return rows.select(
        "v", "up", "root", (F.col("d") + 1).alias("depth"), F.coalesce("h", "n").alias("near"), F.lit(1).cast("long").alias("size"), place, place.alias("rgt"), *kept
    )


def _strong(space: Workspace, edges: DataFrame) -> DataFrame:
    """The edges (p, c, b) that lie inside a strongly connected component. Rounds follow the longest chain of edges that
    isn't trimmed away; edges are only those between heads."""
    found: DataFrame | None = None
    todo = edges
    while True:
        size = -1
        while True:  # nodes that no edge enters or none leaves lie on no circle
            todo = space.write(
                todo.join(todo.select(F.col("c").alias("p")).distinct(), "p", "left_semi")
                .join(todo.select(F.col("p").alias("c")).distinct(), "c", "left_semi")
                .select("p", "c", "b"),
                "core",
            )
            now = todo.count()
            if now == size:
                break
            size = now
        if not size:
            break
        # forward: each node takes the highest node that reaches it
        color = space.write(todo.select(F.explode(F.array("p", "c")).alias("v")).distinct().select("v", F.col("v").alias("k")), "color")
        changed = True
        while changed:
            up = todo.join(color, F.col("p") == F.col("v")).groupBy(F.col("c").alias("v")).agg(F.max("k").alias("m"))
            new = space.write(color.join(up, "v", "left").select("v", F.greatest("k", "m").alias("k"), F.coalesce(F.col("m") > F.col("k"), F.lit(False)).alias("up")), "color")
            changed = not new.where("up").isEmpty()
            color = new.select("v", "k")
        # backward inside a color: what reaches the node that gave it is one component
        same = (
            todo.join(color.select(F.col("v").alias("p"), F.col("k").alias("kp")), "p")
            .join(color.select(F.col("v").alias("c"), F.col("k").alias("kc")), "c")
            .where("kp = kc").select("p", "c", "b")
        )
        same = space.write(same, "same")
        inside = space.write(color.where("v = k").select("v"), "inside")
        count, now = -1, inside.count()
        while now != count:
            count = now
            more = same.join(inside.select(F.col("v").alias("c")), "c", "left_semi").select(F.col("p").alias("v"))
            inside = space.write(inside.union(more).distinct(), "inside")
            now = inside.count()
        ok = inside.select(F.col("v").alias("p"))
        part = same.join(ok, "p", "left_semi").join(inside.select(F.col("v").alias("c")), "c", "left_semi")
        found = space.write(part if found is None else found.unionByName(part), "strong")
        todo = same.join(ok, "p", "left_anti").join(inside.select(F.col("v").alias("c")), "c", "left_anti")
    return found if found is not None else edges.where("false")


def _touched(forest: Forest) -> tuple[DataFrame, DataFrame]:
    """The pages with children of all trees that a further link starts or ends in, and the leaves among its ends."""
    ends = forest.extra.select(F.explode(F.array("p", "c")).alias("v")).distinct()
    leaves = forest.space.write(forest.leaves.join(ends, "v", "left_semi"), "leaf_ends")
    some = ends.union(leaves.select("up")).distinct()
    roots = forest.inner.join(some, "v", "left_semi").select("root").distinct()
    return forest.space.write(forest.inner.join(roots, "root", "left_semi").select(*forest.inner.columns), "touched"), leaves


def circle_pages(forest: Forest, at: DataFrame, leaves: DataFrame) -> DataFrame:
    """v of every page on a circle of links within its run. at: nested sets of all trees that further links touch; leaves:
    positions of the leaves among their ends (or of more).

    All circles of parent links are opened, so every circle holds a further link. A further link that leads to an ancestor,
    whose range holds the range of the link's start, closes the way down between the two. A link from an ancestor adds
    nothing. Only links across the tree need a search: the graph is condensed to heads (pages that further links lead to),
    where a head reaches the heads right below it and those that links from pages right below it lead to; an edge inside a
    strongly connected component closes the way down that it stands for. The pages on all these ways are counted by sums
    over nested-set ranges: a way down counts at its end and stops counting above its top.
    """
    space = forest.space
    columns = ["v", "root", "near", "lft", "rgt"]
    pages = at.select(*columns).unionByName(leaves.select(*columns))
    heads = forest.extra.select(F.col("c").alias("v")).distinct().withColumn("head", F.lit(True))
    ends = forest.extra.select(F.explode(F.array("p", "c")).alias("v")).distinct()
    ends = space.write(pages.join(ends, "v", "left_semi").join(heads, "v", "left"), "ends")
    side = lambda s: ends.select(*[F.col(c).alias(f"{c}_{s}") for c in ("v", "root", "near", "head", "lft", "rgt")])
    links = forest.extra.join(side("p"), F.col("p") == F.col("v_p")).join(side("c"), F.col("c") == F.col("v_c"))
    same = F.col("root_p") == F.col("root_c")
    back = same & F.col("lft_p").between(F.col("lft_c"), F.col("rgt_c"))
    ahead = same & F.col("lft_c").between(F.col("lft_p"), F.col("rgt_p"))
    gate = F.when(F.col("head_p"), F.col("p")).otherwise(F.col("near_p"))
    links = links.select("p", "c", F.col("root_p").alias("root"), F.col("lft_c").alias("top"), F.col("lft_p").alias("bottom"), gate.alias("gate"), back.alias("back"), ahead.alias("ahead"))
    links = space.write(links.where("back OR NOT ahead"), "further")
    ways = links.where("back").select("root", "top", "bottom")
    if not links.where("NOT back").isEmpty():
        down = ends.where("head AND near IS NOT NULL").select(F.col("near").alias("p"), F.col("v").alias("c"), F.col("lft").alias("b"))
        across = links.where("gate IS NOT NULL AND gate <> c").select(F.col("gate").alias("p"), "c", F.col("bottom").alias("b"))
        strong = _strong(space, down.unionByName(across))
        tops = ends.select(F.col("v").alias("p"), "root", F.col("lft").alias("top"))
        ways = ways.unionByName(strong.join(tops, "p").select("root", "top", F.col("b").alias("bottom")))
    events = ways.select("root", F.explode(F.array(
        F.struct((2 * F.col("bottom")).alias("at"), F.lit(1).alias("w")), F.struct((2 * F.col("top") - 1).alias("at"), F.lit(-1).alias("w"))
    )).alias("x")).select("root", "x.*")
    events = space.write(events.groupBy("root", "at").agg(F.sum("w").alias("w")), "events")
    asked = pages.join(events.select("root").distinct(), "root", "left_semi").select("root", "v", F.explode(F.array(
        F.struct((2 * F.col("rgt")).alias("at"), F.lit(1).alias("sign")), F.struct((2 * F.col("lft") - 1).alias("at"), F.lit(-1).alias("sign"))
    )).alias("x")).select("root", "v", "x.*")
    none = F.lit(None)
    line = asked.withColumn("w", F.lit(0).cast("long")).unionByName(events.select("root", none.cast("long").alias("v"), "at", none.cast("int").alias("sign"), "w"))
    summed = _prefix(line, "root", F.shiftright("at", 16), ["at"], "w", "sum", ties=True)
    inside = summed.where("v IS NOT NULL").groupBy("v").agg(F.sum(F.col("sign") * F.col("sum")).alias("n")).where("n > 0")
    return inside.select("v").unionByName(forest.loops).distinct()


def circles(edges: DataFrame, **columns: str) -> DataFrame:
    """(run_id, url) of the pages on a circle of links within one run; a page that links to itself is one. See
    `build_forest` for nulls and repeated links. An empty table gives no rows. Ranges are computed for the trees that links
    beyond the parent links touch; the others hold no circle."""
    forest = build_forest(edges, **columns)
    inner, leaves = _touched(forest)
    at = forest.space.write(nested_sets(forest, inner), "sets")
    found = circle_pages(forest, at, _with_leaves(forest, leaves, at))
    return forest.pages.join(forest.space.write(found, "found"), "v", "left_semi").select(F.col("run").alias("run_id"), "url").distinct()


def further_ranges(forest: Forest, sets: DataFrame) -> DataFrame:
    """(v, ranges, reached): the nested-set ranges (root, lft, rgt) that hold the descendants which links beyond the parent
    links add to a page, and how many pages its own range and these hold, itself apart. Only pages with such ranges.

    A page reaches, by its further links and those of the pages under it, the heads they lead to; the heads' own reach is
    closed by doubling. Of a page's ranges only those that lie in no other of them, its own included, are kept: ranges of
    a forest are nested or apart, so they are disjoint. The pairs (page, head) are as many as the answer has, before that.
    sets: v, run, root, lft, rgt, path of all pages.
    """
    space = forest.space
    tails = sets.join(forest.extra.select(F.col("p").alias("v")).distinct(), "v", "left_semi")
    above = tails.select(F.col("v").alias("p"), "run", F.explode("path").alias("url")).select("p", F.xxhash64("run", "url").alias("v"))
    first = space.write(above.join(forest.extra, "p").select("v", "c").distinct(), "reach")
    heads = forest.extra.select(F.col("c").alias("v")).distinct()
    closed, size = space.write(first.join(heads, "v", "left_semi"), "closed"), -1
    now = closed.count()
    while now != size:
        on = closed.alias("s").join(closed.alias("t"), F.col("s.c") == F.col("t.v")).select("s.v", "t.c")
        new, size = space.write(closed.unionByName(on).distinct(), "closed"), now
        space.drop(closed)
        closed, now = new, new.count()
    on = first.alias("s").join(closed.alias("t"), F.col("s.c") == F.col("t.v")).select("s.v", "t.c")
    reach = space.write(first.unionByName(on).distinct(), "reach")
    place = sets.select("v", "root", "lft", "rgt")
    own = place.join(reach.select("v").distinct(), "v", "left_semi").withColumn("own", F.lit(True))
    every = own.unionByName(
        reach.where("v <> c").join(place.withColumnRenamed("v", "c"), "c").select("v", "root", "lft", "rgt", F.lit(False).alias("own"))
    )
    w = Window.partitionBy("v", "root").orderBy("lft", F.desc("rgt")).rowsBetween(Window.unboundedPreceding, -1)
    outer = every.withColumn("covered", F.max("rgt").over(w)).where("covered IS NULL OR lft > covered")
    return outer.groupBy("v").agg(
        F.sort_array(F.collect_list(F.when(~F.col("own"), F.struct("root", "lft", "rgt")))).alias("ranges"),
        (F.sum(F.col("rgt") - F.col("lft") + 1) - 1).alias("reached"),
    ).where(F.size("ranges") > 0)


def hierarchy(edges: DataFrame, **columns: str) -> DataFrame:
    """Each page of each run with parent_url, root_url (start page), depth, descendants (how many in the tree), lft and rgt,
    path (urls from the start page down to it), on_circle, all_descendants (how many by all links) and further_ranges.

    lft and rgt cover the descendants by parent links: the pages of the same root_url and run whose lft lies between its
    own lft and rgt. Those that further links of pages with several parents add lie in further_ranges (root_url, lft, rgt),
    which is empty where they add none; the page itself, if a circle leads back to it, isn't counted. `descendants_of`
    lists all of them. Ancestors by parent links are those whose range holds a page's lft. Pages on or under a circle that
    no start page leads to hang under that circle's page with the lowest url. See `build_forest` for nulls, repeated links and
    several parents. An empty table gives no rows.
    """
    forest = build_forest(edges, **columns)
    space = forest.space
    lone = forest.loops.join(forest.inner.select("v").union(forest.leaves.select("v")), "v", "left_anti")  # linked with itself only
    nothing = F.lit(None).cast("long")
    lone = lone.select("v", nothing.alias("up"), F.col("v").alias("root"), F.lit(0).alias("depth"), nothing.alias("near"), F.lit(1).cast("long").alias("size"))
    names = space.write(forest.pages.distinct(), "names")
    at = space.write(nested_sets(forest, forest.inner.unionByName(lone), names), "sets")
    leaves = _with_leaves(forest, forest.leaves, at).join(names.select("v", "url"), "v")
    leaves = leaves.withColumn("path", F.concat("path", F.array("url"))).drop("url")
    sets = space.write(at.unionByName(leaves).join(names, "v"), "sets")
    ends = forest.extra.select(F.explode(F.array("p", "c")).alias("v")).distinct()
    touched = sets.join(forest.extra.select(F.explode(F.array("p", "c")).alias("v")).join(sets, "v").select("root").distinct(), "root", "left_semi")
    deep = touched.where("size > 1")
    single = touched.where("size = 1").join(ends, "v", "left_semi")
    on = circle_pages(forest, deep, single).select("v", F.lit(True).alias("on_circle"))
    more = further_ranges(forest, sets)
    root = names.select(F.col("v").alias("root"), F.col("url").alias("root_url"))
    each = more.select("v", "reached", F.explode("ranges").alias("r")).select("v", "reached", "r.*").join(root, "root")
    more = each.groupBy("v").agg(F.first("reached").alias("reached"), F.sort_array(F.collect_list(F.struct("root_url", "lft", "rgt"))).alias("further_ranges"))
    out = sets.join(on, "v", "left").join(more, "v", "left")
    return out.select(
        F.col("run").alias("run_id"), "url", F.when(F.col("depth") > 0, F.element_at("path", -2)).alias("parent_url"), F.get("path", F.lit(0)).alias("root_url"),
        F.col("depth").cast("long").alias("depth"), (F.col("size") - 1).alias("descendants"), "lft", "rgt", "path", F.coalesce("on_circle", F.lit(False)).alias("on_circle"),
        F.coalesce("reached", F.col("size") - 1).alias("all_descendants"),
        F.coalesce("further_ranges", F.array().cast("array<struct<root_url:string,lft:bigint,rgt:bigint>>")).alias("further_ranges"),
    )


def descendants_of(tree: DataFrame, some: DataFrame) -> DataFrame:
    """(run_id, url, descendant, distance) for the pages of `some` (run_id, url), by their nested-set ranges and further
    ranges. distance is null for descendants that only further links lead to.

    Positions are cut into blocks: a range meets each block it touches, so the join is by tree and block, and a tree with a
    third of all pages is spread."""
    a = tree.join(some.select("run_id", "url").distinct(), ["run_id", "url"], "left_semi")
    own = F.struct("root_url", "lft", "rgt")
    a = a.select("run_id", "url", "depth", own.alias("own"), F.explode(F.concat(F.array(own), "further_ranges")).alias("r"))
    a = a.withColumn("block", F.explode(F.sequence(F.shiftright("r.lft", 10), F.shiftright("r.rgt", 10)))).alias("a")
    d = tree.select("run_id", "root_url", "lft", "url", "depth", F.shiftright("lft", 10).alias("block")).alias("d")
    on = (F.col("a.run_id") == F.col("d.run_id")) & (F.col("a.r.root_url") == F.col("d.root_url")) & (F.col("a.block") == F.col("d.block"))
    inside = (F.col("d.lft") >= F.col("a.r.lft")) & (F.col("d.lft") <= F.col("a.r.rgt")) & (F.col("d.url") != F.col("a.url"))
    below = (F.col("d.root_url") == F.col("a.own.root_url")) & F.col("d.lft").between(F.col("a.own.lft"), F.col("a.own.rgt"))
    found = a.join(d, on & inside).where(~below | (F.col("a.r") == F.col("a.own")))
    return found.select("a.run_id", "a.url", F.col("d.url").alias("descendant"), F.when(below, F.col("d.depth") - F.col("a.depth")).alias("distance"))
