"""Mixing sources to target weights: exact quotas, a splitting tree over output shards, and disjoint permuted blocks."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkademia.session import Workspace

#: The folder of the public vocabularies; a parameter wherever it is used.
TOKENIZERS = "/opt/tokenizers"


def token_counts(df: DataFrame, text: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """df with a column `tokens`: the length of `text` in tokens of a public byte-level BPE. Null and empty texts have 0.
    Whole texts are counted. The vocabulary is sent to the executors as a file and read once a Python process."""
    names = df.columns
    df.sparkSession.sparkContext.addFile(os.path.join(folder, vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(SparkFiles.get(vocabulary))
        for b in batches:
            n = [0 if not t else len(enc.encode_ordinary(t)) for t in b.column(names.index(text)).to_pylist()]
            cols = [b.column(i) for i, c in enumerate(names) if c != text]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], names=[*[c for c in names if c != text], "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)
    return df.mapInArrow(count, f"{fields}, tokens long")


@lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, words joined by an underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_"), r"^_+|_+$", "")


def quotas(available: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens to take from each source. Without `total`, the largest total at which every source that has any tokens can
    give its share within its repeats; with it, the shares of that total, cut to what the repeats allow. Sources without
    tokens give 0, and their share is missing."""
    have = {s: (share, rep) for s, share, rep in targets if available.get(s, 0) > 0 and share > 0 and rep > 0}
    if not have:
        return {s: 0 for s, _, _ in targets}
    if total is None:
        total = min(available[s] * rep / share for s, (share, rep) in have.items())
    out = {s: 0 for s, _, _ in targets}
    for s, (share, rep) in have.items():
        out[s] = int(min(share * total, available[s] * rep))
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, k: int) -> int:
    """How many of k draws without replacement are good, exactly, for any numbers up to 2^62. numpy draws up to 10^9; beyond,
    each element is taken by chance k / all, and of those taken too many are put back at random, or of the others some
    added: draws of about the root of k, by the same function."""
    if not good or not k:
        return 0
    if k == good + bad or not bad:
        return good if k == good + bad else k
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, k))
    if 2 * k > good + bad:
        return good - hypergeometric(rng, good, bad, good + bad - k)
    if k <= 64:
        hits = 0
        for i in range(k):
            hits += int(rng.integers(0, good + bad - i)) < good - hits
        return hits
    a, b = int(rng.binomial(good, k / (good + bad))), int(rng.binomial(bad, k / (good + bad)))
    if a + b > k:
        return a - hypergeometric(rng, a, b, a + b - k)
    return a + hypergeometric(rng, good - a, bad - b, k - a - b)


def _halved(node: tuple, seed: int) -> list[tuple]:
    """A node (first shard, last + 1, blocks of each source, blocks of each source before it) cut in two. The left half's
    blocks are drawn without replacement from all blocks of the node: a multivariate hypergeometric draw over the sources.
    The draw depends on the seed and the node's shards alone."""
    lo, hi, counts, before = node
    mid = (lo + hi) // 2
    rest, rng, left = sum(counts), np.random.default_rng([seed, lo, hi]), []
    want = rest * (mid - lo) // (hi - lo)
    for n in counts:
        rest -= n
        left.append(hypergeometric(rng, n, rest, want))
        want -= left[-1]
    return [(lo, mid, left, before), (mid, hi, [n - x for n, x in zip(counts, left)], [x + y for x, y in zip(before, left)])]


def splitting_tree(blocks: list[int], shards: int, seed: int = 0) -> Iterator[tuple]:
    """The leaves (shard, shard + 1, blocks of each source, blocks of each source in the shards before); each source's counts
    add up to its blocks exactly. One path of the tree is held at a time."""
    yield from _leaves((0, shards, list(blocks), [0] * len(blocks)), seed)


def _leaves(node: tuple, seed: int) -> Iterator[tuple]:
    todo = [node]
    while todo:
        node = todo.pop()
        if node[1] - node[0] == 1:
            yield node
        else:
            todo += reversed(_halved(node, seed))


def _shard_quotas(spark: SparkSession, blocks: dict[str, int], shards: int, seed: int) -> DataFrame:
    """(source, block, shard): the shards take disjoint runs of each source's blocks. The driver cuts the tree into at most
    1,024 nodes; tasks go on from there."""
    names = sorted(blocks)
    nodes = [(0, shards, [blocks[s] for s in names], [0] * len(names))]
    while len(nodes) < 1024 and any(n[1] - n[0] > 1 for n in nodes):
        nodes = [x for n in nodes for x in (_halved(n, seed) if n[1] - n[0] > 1 else [n])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node in zip(*[c.to_pylist() for c in b.columns]):
                rows = [(s, shard, before[i], counts[i]) for shard, _, counts, before in _leaves(node, seed) for i, s in enumerate(names) if counts[i]]
                cols = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["source", "shard", "first", "n"])

    top = spark.createDataFrame(nodes, "lo long, hi long, counts array<long>, before array<long>")
    runs = top.repartition(min(len(nodes), 64)).mapInArrow(run, "source string, shard long, first long, n long")
    # a shard's run of a source is far shorter than an array may be: a shard has about shard_tokens tokens
    return runs.select("source", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("block"), "shard")


def _placed(sized: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Documents with their exact place in a random permutation of their source: rank, and tokens before them. Sources are
    cut into hash buckets, so a source with a third of all documents is ranked in `buckets` parts, about the root of the
    documents; only the buckets' totals are summed across."""
    h = F.xxhash64("doc_id", F.lit(seed))
    rows = sized.select("doc_id", "source", "tokens", h.alias("h"), F.floor((F.shiftrightunsigned(h, 32) * F.lit(buckets)) / F.lit(1 << 32)).cast("long").alias("bucket"))
    totals = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(w), F.lit(0)).alias("t0"))
    w = Window.partitionBy("source", "bucket").orderBy("h", "doc_id")
    rows = rows.withColumn("rank", F.row_number().over(w) - 1)
    rows = rows.withColumn("before", F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(totals, ["source", "bucket"]).select(
        "doc_id", "source", "tokens", (F.col("rank") + F.col("n0")).alias("rank"), (F.col("before") + F.col("t0")).alias("before")
    )


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total: int | str | None = None,
    block_docs: int = 16,
    shard_tokens: int = 1_000_000,
    seed: int = 0,
    vocabulary: str = "byte_bpe_multi_50k.tiktoken",
    folder: str = TOKENIZERS,
) -> DataFrame:
    """The mixture: doc_id, source, tokens, copy (0 for a document's first use), shard, position within the shard.

    Each source gives its quota of tokens (see `quotas`) in whole passes over its documents and then the first documents
    of a random permutation of them, so no document is used more often than max_repeats and uses differ by one at most;
    the last document is taken if at least half of it is missing. The uses of a source in permuted order form blocks of
    `block_docs`; the splitting tree says how many blocks of each source go to each shard, the shards take disjoint runs
    of them, and the documents are shuffled within each shard. total="corpus" stands for as many tokens as the documents
    of all targets have: scarce sources stop at their repeats, and don't shrink what the others give.

    Sources are compared apart from case, blanks, hyphens and underscores. Documents without id, source, text or tokens,
    and of sources without a target, aren't used. Rows that repeat a doc_id count as one document, the longest. Targets
    are configuration: few rows. Empty inputs give no rows; other columns aren't read.
    """
    spark = documents.sparkSession
    goals = [
        (r[0], float(r[1]), int(r[2]))
        for r in targets.where(F.col("source").isNotNull() & F.col("target_share").isNotNull() & F.col("max_repeats").isNotNull())
        .groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.sum("target_share"), F.min("max_repeats"))
        .collect()
    ]
    names = [g[0] for g in goals]
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long"), source_name(F.col("source")).alias("source"), F.col("text").alias("text")
    )
    docs = docs.where(F.col("source").isin(names)) if names else docs.where("false")
    sized = token_counts(docs, "text", vocabulary, folder).where("tokens > 0")
    sized = sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("m")).select("doc_id", "m.source", "m.tokens")
    space = Workspace(spark, "mix")
    sized = space.write(sized, "sized")
    have = {r[0]: (r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("tokens"), F.count(F.lit(1))).collect()}
    if total == "corpus":
        total = sum(t for t, _ in have.values())
    quota = quotas({s: t for s, (t, _) in have.items()}, goals, total)
    plan = {}  # source -> whole passes, tokens of the last pass
    repeats = {s: r for s, _, r in goals}
    for s, (tokens, _) in have.items():
        passes, rest = divmod(quota[s], tokens)
        plan[s] = (int(min(passes, repeats[s])), int(rest) if passes < repeats[s] else 0)
    placed = _placed(sized, max(1, isqrt(sum(n for _, n in have.values())) // 4), seed)
    source_map = lambda k: _by_source(plan, k)
    last = F.when(F.col("before") + F.col("tokens") / 2 <= source_map(1), 1).otherwise(0)
    uses = placed.withColumn("uses", source_map(0) + F.when(source_map(1) > 0, last).otherwise(0)).where("uses > 0")
    used = uses.select("doc_id", "source", "tokens", "rank", F.explode(F.sequence(F.lit(0), F.col("uses").cast("int") - 1)).alias("copy"))
    counts = {s: n for s, (_, n) in have.items()}
    # a copy's place in its source's sequence of uses: whole passes first
    used = used.withColumn("place", F.col("copy").cast("long") * _by_source({s: (n,) for s, n in counts.items()}, 0) + F.col("rank"))
    used = used.withColumn("block", F.floor(F.col("place") / block_docs).cast("long"))
    # only blocks that hold a use: the last pass ends after `rest` tokens
    used = space.write(used, "used")
    ends = used.groupBy("source").agg((F.max("block") + 1).alias("b"), F.sum("tokens").alias("t")).collect()
    blocks = {r[0]: int(r[1]) for r in ends}
    if not blocks:
        return used.select("doc_id", "source", "tokens", "copy", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("position"))
    shards = max(1, -(-sum(int(r[2]) for r in ends) // shard_tokens))
    used = used.join(_shard_quotas(spark, blocks, shards, seed), ["source", "block"])
    order = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", F.lit(seed + 1)), "doc_id", "copy")
    return used.select("doc_id", "source", "tokens", "copy", "shard", (F.row_number().over(order) - 1).cast("long").alias("position"))


def _by_source(values: dict, k: int) -> Column:
    out = F.lit(0).cast("long")
    for s, v in values.items():
        out = F.when(F.col("source") == s, F.lit(int(v[k])).cast("long")).otherwise(out)
    return out


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: source, target_share, share reached, tokens, documents, uses, most_uses (of one document),
    max_repeats, reached (within a hundredth of the total). A source without documents has share 0."""
    per_doc = mixture.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    got = per_doc.groupBy("source").agg(
        F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("n").alias("uses"), F.max("n").alias("most_uses")
    )
    all_tokens = got.agg(F.sum("tokens")).scalar()
    goal = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.coalesce(F.col("tokens") / all_tokens, F.lit(0.0))
    return goal.join(got, "source", "left").select(
        "source", "target_share", share.alias("share"), zero("tokens"), zero("documents"), zero("uses"), zero("most_uses"),
        "max_repeats", (F.abs(share - F.col("target_share")) <= 0.01).alias("reached"),
    )
