"""Duplicates that differ only in how they are written: canonical keys, and a ledger of their counts."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Collection, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkademia.session import Workspace

# Awards that may stand before or after the subject.
AWARDS = (
    "ba", "bsc", "beng", "bba", "bcom", "bed", "bfa", "llb", "ma", "msc", "meng", "mba", "mphil", "mres", "mfa", "mpa", "mph", "msw",
    "msci", "mphys", "llm", "phd", "dphil", "dba", "edd", "学士", "修士", "博士",
)


@lru_cache(1 << 14)
def _kept(ch: str) -> bool:
    """Letters, digits and combining marks count; white space, controls, punctuation and symbols don't."""
    return unicodedata.category(ch)[0] in "LNM"


def fold(text: str) -> str:
    """One form for upper and lower case and for composed and decomposed accents."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


_ASCII_DROP = re.compile(r"[^a-z0-9]+")


def squeeze(text: str) -> str:
    """The folded text without white space (visible or not), punctuation and symbols."""
    t = fold(text)
    if t.isascii():
        return _ASCII_DROP.sub("", t)
    return unicodedata.normalize("NFC", "".join(ch for ch in t if _kept(ch)))


#: Invisible characters that join or hyphenate; the zero-width space isn't one, it separates.
_JOINING = "\u00ad\u200c\u200d\u2060\ufeff"


def _words(text: str) -> list[str]:
    """Words of the folded text; a full stop doesn't end one, so that M.Sc. stays whole, nor do joining characters."""
    out, word = [], []
    for ch in fold(text):
        if _kept(ch):
            word.append(ch)
        elif ch != "." and ch not in _JOINING and word:
            out.append("".join(word))
            word = []
    if word:
        out.append("".join(word))
    return out


def name_key(text: str, awards: Collection[str] = AWARDS) -> str:
    """The squeezed subject and the award, wherever that stands and in however many pieces, as in "L. L. M."."""
    words = _words(text)
    pieces = min(max(map(len, awards), default=0), len(words))  # of a letter each at the least
    for n in range(1, pieces + 1):
        if (award := "".join(words[-n:])) in awards:
            return f"{squeeze(''.join(words[:-n]))}|{award}"
    for n in range(1, pieces + 1):
        if (award := "".join(words[:n])) in awards:
            return f"{squeeze(''.join(words[n:]))}|{award}"
    flat = squeeze("".join(words))
    for award in awards:  # scripts without spaces
        if not award.isascii() and len(flat) > len(award):
            if flat.endswith(award):
                return f"{flat[: -len(award)]}|{award}"
            if flat.startswith(award):
                return f"{flat[len(award) :]}|{award}"
    return f"{flat}|"


_SPLIT_QUERY = re.compile(r"[&;]")


def url_key(text: str) -> str:
    """The squeezed address, then the query's parameters in a fixed order. Each name and value is squeezed by itself."""
    address, _, query = text.partition("?")
    params = []
    for p in _SPLIT_QUERY.split(query):
        name, _, value = p.partition("=")
        name, value = squeeze(name), squeeze(value)
        if name or value:
            params.append(f"{name}={value}")
    return squeeze(address) + "?" + "&".join(sorted(params))


def _canonical(university, name, url, course, awards: Collection[str] = AWARDS) -> str:
    """One text for all ways of writing a programme."""
    parts = (
        "-" if university is None else "+" + university,
        "-" if name is None else "+" + name_key(name, awards),
        "-" if url is None else "+" + url_key(url),
        "-" if course is None else "+" + squeeze(course),
    )
    return "\x1f".join(parts)


def _flat(c: Column) -> Column:
    """`squeeze` of ASCII text."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def _ascii_name(flat: Column, words: Column, awards: Sequence[str]) -> Column:
    """`name_key` of ASCII text, given as one run of letters and digits and as its words."""
    known = [a for a in awards if a.isascii()]
    keyed = F.concat(flat, F.lit("|"))
    for back in (False, True):  # what is tried first is put on last
        for n in reversed(range(1, max(map(len, known), default=0) + 1)):
            piece = [F.get(words, F.size(words) - n + i if back else F.lit(i)) for i in range(n)]
            award = F.concat(*piece)  # null where there are fewer words
            rest = F.length(flat) - F.length(award)
            subject = F.substring(flat, F.lit(1), rest) if back else F.substring(flat, F.length(award) + 1, rest)
            keyed = F.when(award.isin(known), F.concat(subject, F.lit("|"), award)).otherwise(keyed)
    return keyed


def _ascii_url(c: Column) -> Column:
    """`url_key` of ASCII text."""
    query = F.when(c.contains("?"), F.regexp_replace(c, r"(?s)^[^?]*\?", "")).otherwise("")
    pair = lambda p: F.concat(_flat(F.substring_index(p, "=", 1)), F.lit("="), _flat(F.regexp_replace(p, "(?s)^[^=]*=?", "")))
    params = F.array_sort(F.filter(F.transform(F.split(query, "[&;]"), pair), lambda p: p != "="))
    return F.concat(_flat(F.substring_index(c, "?", 1)), F.lit("?"), F.when(query == "", "").otherwise(F.array_join(params, "&")))


def with_program_key(programs: DataFrame, *columns: Column | str, awards: Sequence[str] = AWARDS) -> DataFrame:
    """`key`, a 128-bit key that rows of one programme share however it is written, and the wanted columns: university_id,
    program_name, source_url and course_type apart from white space, case, punctuation, symbols, accent composition, the
    award's place and the order of query parameters. Null equals only null; an empty text isn't null. Rows in ASCII are read
    by Spark's own functions, in steps so that each part is computed once; only the others go to Python, by the same rules."""
    wanted = [F.col(c) if isinstance(c, str) else c for c in columns]
    names = programs.select(*wanted).columns
    rows = programs.select(*wanted, *[F.col(x).cast("string").alias(f"__{k}") for k, x in zip("unsc", ("university_id", "program_name", "source_url", "course_type"))])
    u, n, s, c = (F.col(f"__{k}") for k in "unsc")
    plain = ~F.concat_ws("", n, s, c).rlike(r"[^\x00-\x7F]")

    @F.pandas_udf(T.StringType())
    def written(u: pd.Series, n: pd.Series, s: pd.Series, c: pd.Series, plain: pd.Series) -> pd.Series:
        clean = lambda x: [None if v is None or v != v else v for v in x.tolist()]
        rows = zip(clean(u), clean(n), clean(s), clean(c), plain)
        return pd.Series([None if p else _canonical(*r, awards) for *r, p in rows], dtype=object)

    rows = rows.withColumn("__plain", plain)
    p = F.col("__plain")
    spaced = F.when(p, F.trim(F.regexp_replace(F.translate(F.lower(n), ".", ""), "[^a-z0-9]+", " ")))
    rows = rows.withColumns({"__other": written(*[F.when(~p, x) for x in (u, n, s, c)], p), "__spaced": spaced})
    rows = rows.withColumns({"__words": F.split("__spaced", " "), "__flat": F.translate("__spaced", " ", "")})
    part = lambda x, key: F.coalesce(F.concat(F.lit("+"), key), F.lit("-"))
    text = F.concat_ws("\x1f", part(u, u), part(n, _ascii_name(F.col("__flat"), F.col("__words"), awards)), part(s, _ascii_url(s)), part(c, _flat(c)))
    return rows.select(F.unhex(F.md5(F.coalesce("__other", text))).alias("key"), *[F.col(x) for x in names])


class Ledger:
    """Counts of canonical keys, kept in a table bucketed by key and brought up to date batch by batch.

    update() aggregates the new batch by key (map-side first, so a hot key is one row a mapper), shuffles only these
    aggregates into the table's buckets and full-outer-joins each bucket with its own; counts are added and the row with
    the lowest id stays the representative. Each update writes a new version, so one that fails leaves the last whole.
    """

    def __init__(self, space: Workspace, buckets: int, keep: tuple[str, ...] = ()):
        self.space, self.buckets, self.keep = space, buckets, keep
        self.table: str | None = None

    def _store(self, df: DataFrame) -> None:
        """A new version. What comes from an aggregate or join by key in as many partitions as there are buckets lies in them
        already; else it is brought there."""
        spark = self.space.spark
        name = f"ledger_{uuid.uuid4().hex[:12]}"
        if int(spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            df = df.repartition(self.buckets, "key")
        path = f"{self.space.root}/{name}"
        df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        old, self.table, self.path = self.table, name, path
        if old:
            spark.sql(f"DROP TABLE IF EXISTS {old}")
            self.space.delete(f"{self.space.root}/{old}")

    def update(self, batch: DataFrame) -> None:
        """batch: key, id and the kept columns."""
        # a lone id is kept by a hash aggregate, a row by a sort
        first = F.min(F.struct("id", *self.keep)) if self.keep else F.min("id")
        new = batch.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), first.alias("first"))
        if self.table is None:
            return self._store(new)
        old = self.read()
        o, n = old.alias("o"), new.alias("n")
        merged = o.join(n, F.col("o.key") == F.col("n.key"), "full_outer").select(
            F.coalesce("o.key", "n.key").alias("key"),
            (F.coalesce("o.copies", F.lit(0)) + F.coalesce("n.copies", F.lit(0))).alias("copies"),
            F.least("o.first", "n.first").alias("first"),
        )
        return self._store(merged)

    def close(self) -> DataFrame:
        """The ledger as a plain table; it leaves the catalog."""
        out = self.space.spark.read.schema(self.read().schema).parquet(self.path)
        self.space.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        return out

    def read(self) -> DataFrame:
        return self.space.spark.table(self.table)


def _prepared(programs: DataFrame, batches: int, buckets: int | None, keep: tuple[str, ...]):
    """The rows with their keys, written once, and the ledger over all of them."""
    spark = programs.sparkSession
    space = Workspace(spark, "ledger")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_program_key(programs.where(F.col("id").isNotNull()), "id", *keep)
    keyed = space.write(rows, "keyed")
    low, high = keyed.agg(F.min("id"), F.max("id")).first()
    ledger = Ledger(space, buckets, keep)
    low, high = (0, 0) if low is None else (low, high)
    step = max(1, -(-(high - low + 1) // batches))
    for start in range(low, high + 1, step):  # at most `batches` rounds; arrival order is the order of id
        ledger.update(keyed.where(F.col("id").between(start, start + step - 1)))
    return keyed, ledger.close()


def collapse(programs: DataFrame, batches: int = 4, buckets: int | None = None) -> DataFrame:
    """One row per programme: first_id, copies (rows that describe it) and the fields of the row with the lowest id.

    The table arrives in `batches` ranges of id, each of which updates the ledger. Rows without id are left out (they
    have no place in the order); other nulls are compared as in `with_program_key`. Rows that repeat an id count as copies. An
    empty table gives no rows. Further columns aren't read.
    """
    keep = ("university_id", "program_name", "source_url", "course_type")
    _, ledger = _prepared(programs, batches, buckets, keep)
    return ledger.select(
        F.col("first.id").alias("first_id"), "copies", *[F.col(f"first.{c}").alias(c) for c in keep]
    )


def copies_of(programs: DataFrame, batches: int = 4, buckets: int | None = None, hot_share: float = 0.001) -> DataFrame:
    """(first_id, copy_id): each row that copies one with a lower id, from the ledger of `collapse`.

    Keys with at least `hot_share` of the rows number 1/hot_share at most, whatever the input; they are broadcast, so a
    group with a third of all rows isn't moved at all. The rest is joined by key.
    """
    keyed, ledger = _prepared(programs, batches, buckets, ())
    counts = ledger.where("copies > 1").select("key", F.col("first").alias("first_id"), "copies")
    least = F.greatest(keyed.agg(F.count(F.lit(1))).scalar() * F.lit(hot_share), F.lit(2))
    hot = counts.where(F.col("copies") >= least).select("key", "first_id")
    cold = counts.where(F.col("copies") < least).select("key", "first_id")
    from_hot = keyed.join(F.broadcast(hot), "key")
    rest = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key")
    pairs = from_hot.unionByName(rest).where(F.col("id") > F.col("first_id"))
    return pairs.select("first_id", F.col("id").alias("copy_id")).distinct()
