"""Has this key been seen before? Elias-Fano sets over hash partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkademia.llm.eliasfano import EliasFano, SeenKeys
from sparkademia.session import Workspace


def _fingerprint(keys: Sequence[str], bits: int):
    """A hash of the key columns. The null flags keep (null, 'a') and ('a', null) apart."""
    h = F.xxhash64(*[F.col(k) for k in keys], *[F.col(k).isNull() for k in keys])
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def _mark_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the rows of each Arrow batch whose key has a lower id in the same batch: they surely came before, and only
    the first of each key in a batch must be looked up. So a hot key sends one row a batch to its partition."""
    for b in batches:
        ids, h = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, h))
        repeated = np.zeros(len(ids), bool)
        if len(ids):
            same = h[order][1:] == h[order][:-1]
            repeated[order[1:]] = same & (ids[order][1:] > ids[order][:-1])
            # equal ids: repeats of the very same row, decided by their first
            tie = same & (ids[order][1:] == ids[order][:-1])
            for k in np.flatnonzero(tie):
                repeated[order[k + 1]] = repeated[order[k]]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(repeated)], names=["id", "h", "repeated"])


def _probe(least: int, keep: bool):
    """Rows (part, id, h, repeated, data) in order of part, data first, then id. Each part starts from its stored set, if
    there is one. Gives the ids that were seen and, with `keep`, each part's new set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last_id, last = None, SeenKeys(least=least), None, {}

        def store() -> Iterator[pa.RecordBatch]:
            if keep and part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([part], pa.int32()), pa.array([seen.flush().to_bytes()], pa.binary())], names=_OUT)

        for whole in batches:
            parts = whole.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else []
            for at, end in zip(cuts, [*cuts[1:], len(parts)]):
                b = whole.slice(at, end - at)
                if parts[at] != part:
                    yield from store()
                    part, seen, last_id, last = int(parts[at]), SeenKeys(least=least), None, {}
                if b.column(4).null_count < len(b):  # stored sets come first; a part has one
                    data = b.column(4).drop_null()
                    seen = SeenKeys(EliasFano.from_bytes(data[0].as_py()), least)
                    b = b.slice(len(data))
                ids = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                h = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                out = ids[b.column(3).to_numpy(zero_copy_only=False).astype(bool)]
                asked = ~b.column(3).to_numpy(zero_copy_only=False).astype(bool)
                ids, h = ids[asked], h[asked]
                if len(ids):
                    hit = seen.add(h)
                    # rows of one id aren't earlier than each other
                    if (ids[1:] == ids[:-1]).any() or ids[0] == last_id:
                        for k in range(len(ids)):
                            if ids[k] != last_id:
                                last_id, last = ids[k], {}
                            hit[k] = last.setdefault(int(h[k]), bool(hit[k]))
                    else:
                        last_id, last = ids[-1], {int(h[-1]): bool(hit[-1])}
                    out = np.concatenate([out, ids[hit]])
                if len(out):
                    none = pa.nulls(len(out))
                    yield pa.RecordBatch.from_arrays([pa.array(out), none.cast(pa.int32()), none.cast(pa.binary())], names=_OUT)
        yield from store()

    return run


_OUT = ["id", "part", "data"]


def _answered(df: DataFrame, keys: Sequence[str], order: str, bits: int, least: int, parts: int | None, store: DataFrame | None) -> DataFrame:
    rows = df.where(F.col(order).isNotNull()).select(F.col(order).cast("long").alias("id"), _fingerprint(keys, bits).alias("h"))
    marked = rows.mapInArrow(_mark_local, "id long, h long, repeated boolean")
    none = F.lit(None)
    if parts is None:  # one set a task
        part = F.lit(0)
        # repeats are answered already; they may go anywhere
        spread = marked.repartition(F.when(F.col("repeated"), F.xxhash64("id")).otherwise(F.col("h")))
        placed = spread.select(part.alias("part"), "id", "h", "repeated", none.cast("binary").alias("data"))
        return placed.sortWithinPartitions("id").mapInArrow(_probe(least, False), "id long, part int, data binary")
    of = F.pmod(F.when(F.col("repeated"), F.xxhash64("id")).otherwise(F.col("h")), F.lit(parts)).cast("int")
    placed = marked.select(of.alias("part"), "id", "h", "repeated", none.cast("binary").alias("data"))
    if store is not None:
        placed = placed.unionByName(store.select("part", none.cast("long").alias("id"), none.cast("long").alias("h"), F.lit(False).alias("repeated"), "data"))
    return placed.repartition("part").sortWithinPartitions("part", F.col("data").isNull(), "id").mapInArrow(_probe(least, True), "id long, part int, data binary")


def seen_before(df: DataFrame, keys: Sequence[str], order: str, bits: int = 64, least: int = 1 << 16) -> DataFrame:
    """The `order` values (column `id`) of the rows whose key already occurred in a row with a lower `order`.

    Rows are spread by the hash of their key. Each partition reads its rows in order and keeps the hashes it has met as
    an Elias-Fano set (about 2 + log2(2^bits / n) bits a key) with a few runs of new ones, merged into the set in
    sequence, block by block. No partition holds keys, only hashes, and the set is never decoded as a whole. Repeats inside
    one Arrow batch are settled before the shuffle and then go to any partition, so that a key with a third of all rows
    reaches its own as one row a batch. The table is read once.

    Wrong answers: a new key is called seen if its hash equals an earlier one's; a repeated key is never missed. Among n
    distinct keys about n^2 / 2^(bits+1) are called wrongly; see `error_report`.

    Null keys equal null keys. Rows without `order` have no place in the sequence and give no result. Rows that share one
    `order` value aren't earlier than each other. An empty table gives no rows.
    """
    if not 8 <= bits <= 64:
        raise ValueError("bits must be 8 to 64")
    return _answered(df, keys, order, bits, least, None, None).select("id")


class SeenStore:
    """The sets of earlier batches, kept as one row a hash part (part, data), so that a later batch reads its own rows and
    the sets, not the earlier rows. Batches come in order: `order` rises from batch to batch. The number of parts is fixed
    when the store is made; a part's set takes about 5 bytes a key at a billion keys and must fit a task.
    """

    def __init__(self, space: Workspace, parts: int, bits: int = 64, least: int = 1 << 16):
        self.space, self.parts, self.bits, self.least = space, parts, bits, least
        self.sets: DataFrame | None = None

    def batch(self, df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
        """The ids of a batch whose key came before, in it or in an earlier batch. See `seen_before` for nulls and ties; rows
        of different batches are never tied. Each batch writes a new version of the sets and replaces the last."""
        out = self.space.write(_answered(df, keys, order, self.bits, self.least, self.parts, self.sets), "batch")
        if self.sets is not None:
            self.space.drop(self._file)
        self._file, self.sets = out, out.where("data IS NOT NULL").select("part", "data")
        return self.space.write(out.where("id IS NOT NULL").select("id"), "seen")


def error_report(df: DataFrame, keys: Sequence[str], order: str, bits: int = 64) -> DataFrame:
    """One row: rows, answers "seen", true repeats, wrong answers, their measured rate and the expected number.

    True repeats are rows minus distinct keys, counted exactly, so rows that share an `order` value would count as wrong;
    the column must be unique. The rate of an empty table is 0.
    """
    rows = df.where(F.col(order).isNotNull())
    flags = [F.col(k) for k in keys] + [F.col(k).isNull() for k in keys]
    exact = (
        rows.groupBy(*[c.alias(f"k{i}") for i, c in enumerate(flags)])
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys"))
    )
    answered = seen_before(df, keys, order, bits).agg(F.count(F.lit(1)).alias("called_seen"))
    d = F.col("distinct_keys").cast("double")
    wrong = F.col("called_seen") - (F.col("total_rows") - F.col("distinct_keys"))
    return exact.withColumn("called_seen", answered.scalar()).select(
        "total_rows",
        "distinct_keys",
        "called_seen",
        wrong.alias("wrong_answers"),
        F.coalesce(wrong / F.nullif(F.col("total_rows"), F.lit(0)), F.lit(0.0)).alias("wrong_rate"),
        (d * d / F.lit(2.0 ** (bits + 1))).alias("expected_wrong"),
    )
