"""Test items that leak into documents: size-partitioned MinHash containment search, verified on the words.

A passage of an item is short against the document around it, so the documents' shingle sets are cut into overlapping
blocks of one bounded size. Items are cut into windows of the shortest passage that counts. Windows and blocks fall into
size classes; for each class the containment that a passage guarantees is turned into a Jaccard similarity by the class's
largest size, and the number of MinHash bands follows from it. A block that shares a band value with a window makes the
document a candidate for the window's item; candidates are verified by exact shingle containment and word by word.

Band values of documents and items meet in a join. Before it, documents drop the values that no item has by a filter of
fixed size; the filter lets some others through, never fewer, so the result doesn't depend on how full it is.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkademia.session import Workspace

U64 = np.uint64

_MARKUP = re.compile(r"<[!/?]?[A-Za-z][^<>]*>|&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z]{2,12});")
_WORD = re.compile(r"[^\W_]+")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_JOINER = re.compile("[­​-‍⁠﻿]")


_ASCII_WORDS = str.maketrans({chr(i): chr(i).lower() if chr(i).isalnum() else " " for i in range(128)})


@lru_cache(2)
def _combining(beyond: bool) -> re.Pattern:
    """All combining marks; those beyond the basic plane apart, because they slow the search."""
    some = range(0x10000, sys.maxunicode + 1) if beyond else range(0x300, 0x10000)
    return re.compile("[" + "".join(chr(i) for i in some if unicodedata.combining(chr(i))) + "]+")


def words_of(text: str) -> list[str]:
    """The words of a text without case, accents, punctuation, markup, invisible characters and line breaks."""
    plain = text.isascii()
    if not plain:
        text = _JOINER.sub("", text)
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if plain:
        return text.translate(_ASCII_WORDS).split()
    text = _combining(False).sub("", unicodedata.normalize("NFKD", text.casefold()))
    if _BEYOND.search(text):
        text = _combining(True).sub("", text)
    return _WORD.findall(text)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U64, len(words))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ h[k : k + n]) * U64(0x9E3779B97F4A7C15)
            out ^= out >> U64(29)
    return out


@dataclass(frozen=True)
class LeakParams:
    """least: words of the shortest passage; one word in `exchange` may differ; shingle: words a shingle; classes: block
    sizes in shingles, smallest first; miss: the accepted chance that a shortest passage shares no band with its block;
    filter_bits: the filter has 2^filter_bits bits, 16 MB by default, which serve some ten million band values well."""

    least: int = 18
    exchange: int = 8
    shingle: int = 5
    classes: tuple[int, ...] = (16, 32)
    miss: float = 1e-3
    seed: int = 1
    filter_bits: int = 27

    @property
    def window(self) -> int:
        """Shingles of a shortest passage."""
        return self.least - self.shingle + 1

    @property
    def shared(self) -> int:
        """Shingles that a shortest passage keeps at the least: exchanged words split it, and a part of w unchanged words
        keeps w - shingle + 1; the fewest are kept by parts of equal length."""
        exchanged = self.least // self.exchange
        parts, left = exchanged + 1, self.least - exchanged
        sizes = [left // parts + (i < left % parts) for i in range(parts)]
        return max(1, sum(max(0, s - self.shingle + 1) for s in sizes))

    def bands(self, size: int) -> int:
        """Bands for blocks of at most `size` shingles: a window contained to shared/window has at least this Jaccard
        similarity with the block, and each band agrees with that probability."""
        jaccard = self.shared / (size + self.window - self.shared)
        return math.ceil(math.log(self.miss) / math.log(1 - jaccard))


@lru_cache(16)
def _hash_family(bands: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([bands, seed])
    mult = rng.integers(0, 2**31, bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return mult, rng.integers(0, 2**32, bands, dtype=np.uint32)


def _minima(shingles: np.ndarray, starts: np.ndarray, size: int, bands: int, seed: int) -> np.ndarray:
    """Keys (blocks x bands) of the MinHash values of the blocks of `size` shingles at `starts`, which rise. A block that
    would end behind the shingles is moved forward. The band's number and the number of bands are hashed in, so that
    values of different bands and classes never meet. Minima over `size` shingles are taken by doubling."""
    mult, add = _hash_family(bands, seed)
    size = min(size, len(shingles))
    starts = np.minimum(starts, len(shingles) - size)
    part = (shingles[starts[0] : starts[-1] + size] >> U64(32)).astype(np.uint32)
    v, width = part[:, None] * mult + add, 1
    while 2 * width <= size:
        v, width = np.minimum(v[:-width], v[width:]), 2 * width
    at = starts - starts[0]
    out = np.minimum(v[at], v[at + size - width]).astype(U64)
    out |= (np.arange(bands, dtype=U64) + U64(bands << 12)) << U64(32)
    with np.errstate(over="ignore"):
        out *= U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(29)
        out *= U64(0xD6E8FEB86659FD93)
    return out ^ (out >> U64(32))


def _class_of(n: int, p: LeakParams) -> int:
    """The size class of a set of n shingles: the smallest that holds it, the largest for all that is longer."""
    return next((c for c in p.classes if n <= c), p.classes[-1])


def item_keys(h: np.ndarray, p: LeakParams) -> Iterator[np.ndarray]:
    """Band keys of all windows of an item's words, for all size classes, some windows at a time."""
    s = shingle_hashes(h, p.shingle)
    starts = np.arange(len(s) - p.window + 1)
    for at in range(0, len(starts), 512):
        yield np.unique(np.concatenate([_minima(s, starts[at : at + 512], p.window, p.bands(c), p.seed).ravel() for c in p.classes]))


def document_keys(h: np.ndarray, p: LeakParams) -> Iterator[np.ndarray]:
    """Band keys of the blocks of a document's words, some blocks at a time."""
    for _, keys in grouped_keys([h], p):
        yield keys.ravel()


def grouped_keys(texts: list[np.ndarray], p: LeakParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the texts, keys): a row of band keys for each block of the texts' words (each has `least` or more). Texts
    of the largest class are taken one after another as one array, as calls on small arrays cost more than the work."""
    whole, longest = [], p.classes[-1]
    for i, h in enumerate(texts):
        n = len(h) - p.shingle + 1
        if n >= longest:
            whole.append(i)
        else:
            size = _class_of(n, p)
            starts = np.arange(0, max(1, n - p.window + 1), size - p.window + 1)
            yield np.full(len(starts), i), _minima(shingle_hashes(h, p.shingle), starts, size, p.bands(size), p.seed)
    if not whole:
        return
    s = shingle_hashes(np.concatenate([texts[i] for i in whole]), p.shingle)  # those across borders are in no block
    owners, starts, at = [], [], 0
    for i in whole:
        n = len(texts[i]) - p.shingle + 1
        own = np.minimum(np.arange(0, n - p.window + 1, longest - p.window + 1), n - longest)
        owners.append(np.full(len(own), i))
        starts.append(at + own)
        at += len(texts[i])
    owners, starts = np.concatenate(owners), np.concatenate(starts)
    for k in range(0, len(starts), 256):
        yield owners[k : k + 256], _minima(s, starts[k : k + 256], longest, p.bands(longest), p.seed)


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three places in the filter for each key."""
    mask = U64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        for i in range(3):
            yield (keys + U64(i) * ((keys >> U64(31)) | U64(1))) & mask


def in_filter(keys: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """The positions of the keys that may be in the filter. Nearly all fail at their first place."""
    set_at = lambda at: ((bitmap[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)
    some = np.flatnonzero(set_at(next(_places(keys, bits))))
    ok = np.ones(len(some), bool)
    for at in _places(keys[some], bits):
        ok &= set_at(at)
    return some[ok]


_PIECE = 1 << 16  # bytes of the filter that are merged and sent at a time


def _filter(index: DataFrame, bits: int) -> np.ndarray:
    """The filter of all keys: each task marks its own, the pieces are united by their number. The driver gets 2^bits bits."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            for at in _places(b.column(0).to_numpy().view(U64), bits):
                np.bitwise_or.at(bitmap, at >> U64(3), np.left_shift(np.uint8(1), (at & U64(7)).astype(np.uint8)))
        for i in range(0, len(bitmap), _PIECE):
            if (piece := bitmap[i : i + _PIECE]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([piece.tobytes()], pa.binary())], names=["at", "piece"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, whole = None, None
        for b in batches:
            for i, piece in zip(b.column(0).to_pylist(), b.column(1)):
                piece = np.frombuffer(piece.as_buffer(), np.uint8)
                if i == place:
                    whole |= piece
                else:
                    if place is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([whole.tobytes()], pa.binary())], names=["at", "piece"])
                    place, whole = i, piece.copy()
        if place is not None:
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([whole.tobytes()], pa.binary())], names=["at", "piece"])

    schema = "at long, piece binary"
    pieces = index.select("key").mapInArrow(mark, schema).repartition("at").sortWithinPartitions("at").mapInArrow(unite, schema)
    out = np.zeros(1 << (bits - 3), np.uint8)
    for at, piece in pieces.collect():
        out[at : at + len(piece)] = np.frombuffer(piece, np.uint8)
    return out


def holds_passage(h: np.ndarray, ih: np.ndarray, p: LeakParams) -> bool:
    """Whether a document's words hold a passage of an item's: some diagonal of the two texts has `least` successive words
    or more of which at most one in `exchange` differs. Diagonals without a common shingle have none."""
    s, own = shingle_hashes(h, p.shingle), shingle_hashes(ih, p.shingle)
    order = np.argsort(own, kind="stable")
    own = own[order]
    lo, hi = np.searchsorted(own, s, "left"), np.searchsorted(own, s, "right")
    hit = np.flatnonzero(hi > lo)
    tried: set[int] = set()
    for at in range(0, len(hit), 256):  # repetitive texts have many pairs of positions on few diagonals
        k = hit[at : at + 256]
        n = hi[k] - lo[k]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for d in np.unique(np.repeat(k, n) - order[np.repeat(lo[k], n) + within]).tolist():
            a, b = max(0, d), min(len(h), d + len(ih))
            if d in tried or b - a < p.least:
                continue
            tried.add(d)
            same = h[a:b] == ih[a - d : b - d]
            # a stretch counts if it is long enough and the sum over it of 1 - exchange * differs isn't negative
            gain = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - p.exchange))])
            best = np.minimum.accumulate(gain[: len(gain) - p.least])
            if len(best) and (gain[p.least :][: len(best)] >= best).any():
                return True
    return False


def leaks(documents: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id): the documents that hold at least `least` successive words of an item with at most one word in
    `exchange` exchanged, ignoring case, accents, punctuation, markup and line breaks.

    The documents are read once, however many the items are. Their band keys are held against a filter of the items' keys,
    whose size is fixed; documents with keys that pass are written with their words as hashes, and only these keys are
    joined with the items' keys. Candidates are verified word by word. Whole texts are searched, in blocks of bounded
    size. Documents without text, id or enough words give no rows; items without text or shorter than a passage can't
    leak; a document that comes twice gives its rows once per doc_id; empty tables give no rows; other columns aren't read.
    """
    spark, p = documents.sparkSession, params
    space = Workspace(spark, "leaks")
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    wanted = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")

    def read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = word_hashes(words_of(text))
                for n, keys in enumerate(item_keys(h, p) if len(h) >= p.least else ()):
                    words = None if n else h.tobytes()  # with the item's first keys only
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item], pa.int64()), pa.array([keys.view(np.int64)], pa.list_(pa.int64())), pa.array([words], pa.binary())], names=["item_id", "keys", "words"]
                    )

    known = space.write(wanted.mapInArrow(read_items, "item_id long, keys array<long>, words binary"), "items")
    index = space.write(known.select(F.explode("keys").alias("key"), "item_id").distinct(), "index")
    bitmap = spark.sparkContext.broadcast(_filter(index, p.filter_bits))

    def read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = bitmap.value
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "keys": [], "words": []}
            docs, texts, size = [], [], 0

            def search() -> None:
                left: dict[int, list] = {}
                for owners, keys in grouped_keys(texts, p):
                    flat = keys.ravel()
                    for k in in_filter(flat, found, p.filter_bits).tolist():
                        left.setdefault(int(owners[k // keys.shape[1]]), []).append(flat[k])
                for i, keys in left.items():
                    out["doc_id"].append(docs[i])
                    out["keys"].append(np.unique(np.array(keys, U64)).view(np.int64))
                    out["words"].append(texts[i].tobytes())

            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = word_hashes(words_of(text))
                if len(h) >= p.least:
                    docs.append(doc)
                    texts.append(h)
                    size += len(h)
                if size > 1 << 13:
                    search()
                    docs, texts, size = [], [], 0
            search()
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["keys"], pa.list_(pa.int64())), pa.array(out["words"], pa.binary())], names=list(out))

    passed = space.write(docs.mapInArrow(read_documents, "doc_id long, keys array<long>, words binary"), "passed")
    pairs = passed.select("doc_id", F.explode("keys").alias("key")).join(index, "key").select("doc_id", "item_id").distinct()
    texts = known.where("words IS NOT NULL").select("item_id", F.col("words").alias("item_words"))
    both = pairs.join(passed.select("doc_id", "words"), "doc_id").join(texts, "item_id").select("doc_id", "item_id", "words", "item_words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda c: [np.frombuffer(x.as_buffer(), U64) for x in c]
        for b in batches:
            ok = [holds_passage(h, ih, p) for h, ih in zip(read(b.column(2)), read(b.column(3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["doc_id", "item_id"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(verify, "doc_id long, item_id long").distinct()


def leak_report(documents: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """One row per item: item_id, suite, documents it leaked into (0 for none)."""
    found = leaks(documents, items, params).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "suite").distinct()
    return rows.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("documents"))
