"""Garbled text from wrong character encodings: garbled forms of the corpus's own words, joined with its tokens.

A token is a run of letters and non-ASCII characters between ASCII white space, digits and punctuation. Every distinct
token is garbled under every chain of wrong decodings; a token of the corpus that equals such a form of another token was
garbled, and that other token is its original. Garbled twice, its original is itself garbled, so originals are followed to
their end.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkademia.session import Workspace

# Fixed values: (true encoding, encoding it was read with) of the chains of one step.
WRONG_READINGS = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "cp1254"),
    ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp852"), ("utf-8", "cp866"), ("utf-8", "mac_roman"),
    ("utf-8", "iso8859_2"), ("utf-8", "iso8859_15"), ("utf-8", "koi8_r"), ("utf-8", "cp932"), ("utf-8", "euc_jp"),
    ("utf-8", "gbk"), ("cp932", "cp1252"), ("cp932", "latin-1"), ("cp932", "mac_roman"), ("cp932", "cp1251"),
    ("euc_jp", "latin-1"), ("euc_jp", "cp1252"), ("euc_jp", "cp932"), ("euc_jp", "mac_roman"), ("cp932", "euc_jp"),
    ("cp1252", "utf-8"), ("cp932", "utf-8"), ("euc_jp", "utf-8"), ("cp1250", "utf-8"), ("mac_roman", "utf-8"),
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1252", "cp437"),
    ("cp437", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1251"), ("cp1250", "cp852"),
]
_SINGLE = {"cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "iso8859_2", "iso8859_15", "koi8_r"}

# Chains of two steps: text garbled once, saved as UTF-8, which holds any text, and read by a one-byte code page again. After a
# first step of the most common readings any of them may follow; after the others, the two most common.
_AGAIN = [k for k, (a, b) in enumerate(WRONG_READINGS) if a == "utf-8" and b in _SINGLE]
TWICE = [(a, b) for a in range(len(WRONG_READINGS)) for b in (_AGAIN if a in _AGAIN else _AGAIN[:2])]
_TWICE_AT = {ab: len(WRONG_READINGS) + n for n, ab in enumerate(TWICE)}

_TOKEN = re.compile("[A-Za-z\u0080-\U0010ffff]+")
#: Characters that only a wrong decoding leaves in a text: the replacement character, C1 controls, the private use area
#: that double-byte code pages fill.
RESIDUE = r"[\x{FFFD}\x{80}-\x{84}\x{86}-\x{9F}\x{E000}-\x{F8FF}]"


@lru_cache(64)
def _table(encoding: str) -> list[str]:
    """What each byte reads as; bytes that the encoding leaves open stay as C1 controls, as in browsers."""
    return [_one(bytes([b]), encoding) for b in range(256)]


def _one(b: bytes, encoding: str) -> str:
    try:
        return b.decode(encoding)
    except UnicodeDecodeError:
        return b.decode("latin-1")


@lru_cache(64)
def _back(encoding: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_table(encoding))))}


def _write(text: str, encoding: str) -> bytes | None:
    """The bytes of a text, or None where the encoding lacks a character."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in _SINGLE:
            return None
        back = _back(encoding)
        try:
            return bytes(back[c] for c in text)
        except KeyError:
            return None


def garble(text: str, true: str, read: str) -> str | None:
    """What the text looks like after its bytes in `true` were decoded as `read`; None if it can't or doesn't change."""
    data = _write(text, true)
    if data is None:
        return None
    out = _read(data, read)
    return out if out != text else None


def _read(data: bytes, encoding: str) -> str:
    return codecs.charmap_decode(data, "strict", _charmap(encoding))[0] if encoding in _SINGLE else data.decode(encoding, "replace")


@lru_cache(64)
def _charmap(encoding: str) -> str:
    return "".join(_table(encoding))


def _telling(true: str, read: str, form: str, whole: bool) -> bool:
    """Whether a garbled form may stand for its word. Reading as UTF-8 garbles only where it fails; what it reads well is
    the way back of another chain. Between one-byte encodings one letter becomes another, and double-byte characters
    become two, so short forms there, and short pieces, may be words of their own."""
    if read == "utf-8":
        return "\ufffd" in form and len(form) >= 3
    if true in _SINGLE and read in _SINGLE:
        return whole and len(form) >= 5
    if true != "utf-8" or not whole:
        return len(form) >= 4
    return True


def forms(word: str) -> Iterator[tuple[str, int]]:
    """The garbled tokens of a word with their chain's number; a form that the tokenizer cuts gives its pieces, numbered
    -1 - chain."""
    once = {}
    for k, (true, read) in enumerate(WRONG_READINGS):
        g = garble(word, true, read)
        if g is None:
            continue
        once[k] = g
        pieces = _TOKEN.findall(g)
        whole = len(pieces) == 1
        for p in pieces:
            if not p.isascii() and p != word and _telling(true, read, p, whole):
                yield p, k if whole else -1 - k
    again: dict[str, int] = {}  # many code pages agree on a word; its first chain stands for them
    for a, g in once.items():
        if "\ufffd" not in g:
            again.setdefault(g, a)
    made = {word, *once.values()}
    for once_more, a in again.items():
        data = once_more.encode("utf-8", "surrogatepass")
        for b in _AGAIN if a in _AGAIN else _AGAIN[:2]:
            g = codecs.charmap_decode(data, "strict", _charmap(WRONG_READINGS[b][1]))[0]
            if g in made:
                continue
            made.add(g)
            least = 2 if a < 2 and b < 2 else 4  # rarer chains leave short pieces that tell less
            for p in _TOKEN.findall(g):
                if len(p) >= least and not p.isascii() and p != word:
                    yield p, _TWICE_AT[a, b]


#: Chains whose reverse is also a chain: which of two words is the original, their frequencies say.
TWO_WAY = [k for k, (a, b) in enumerate(WRONG_READINGS) if "utf-8" not in (a, b) and (b, a) in WRONG_READINGS or {a, b} <= _SINGLE]


@lru_cache(1)
def character_forms() -> re.Pattern:
    """UTF-8 of accented letters, signs and general punctuation read byte by byte: a lead and its continuation characters.
    Only code pages in which no language writes such sequences."""
    parts = []
    for read, leads in (("cp1252", (0xC3, 0xC4, 0xC5)), ("latin-1", (0xC3, 0xC4, 0xC5)), ("cp850", (0xC3,)), ("mac_roman", (0xC3,))):
        t = _table(read)
        some = lambda codes: "[" + "".join(re.escape(t[c]) for c in codes) + "]"  # noqa: E731, B023
        parts.append(some(leads) + some(range(0x80, 0xC0)))
        parts.append(re.escape(t[0xC2]) + some(range(0xA0, 0xC0)))
        parts.append(re.escape(t[0xE2]) + some((0x80, 0x82, 0x84, 0x86)) + some(range(0x80, 0xC0)))
        parts.append(re.escape(t[0xEF] + t[0xBF] + t[0xBD]))  # the replacement character itself
    return re.compile("|".join(parts))


def _tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, token) for each distinct token of a document with a non-ASCII character."""
    text = F.col("text")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z\x{80}-\x{10FFFF}]*[\x{80}-\x{10FFFF}][A-Za-z\x{80}-\x{10FFFF}]*)"), F.lit(1)))
    return documents.select("doc_id", F.explode(found).alias("token"))


def _sorted(side: DataFrame) -> DataFrame:
    """A side that must not be broadcast: words repeat so much that their files are a hundredth of what they take in memory,
    so the planner would think it small."""
    return side.hint("merge")


def _hash(text: str) -> int:
    """Spark's xxhash64 of a text."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def _garbled_vocabulary(space: Workspace, tokens: DataFrame) -> DataFrame:
    """(token, original, chain): the corpus's tokens that are a garbled form of another token of the corpus.

    Forms are made in as many tasks as a shuffle has and meet the tokens by their hashes, so that no form is moved as text;
    what meets is spelled out and verified."""
    spark = space.spark
    vocabulary = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", F.xxhash64("token").alias("h"), "n")
    vocabulary = space.write(vocabulary, "vocabulary")
    names = ["h", "of", "chain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for word, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for form, chain in set(forms(word)):
                    out[0].append(_hash(form))
                    out[1].append(own)
                    out[2].append(chain)
                if len(out[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=names)
                    out = ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=names)

    spread = vocabulary.select("token", "h").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h")
    table = spread.mapInArrow(run, "h long, of long, chain int")
    hit = space.write(table.join(_sorted(vocabulary.select("h", "n")), "h"), "hits")
    seen = vocabulary.select(F.col("h").alias("own"), F.col("token").alias("original"), F.col("n").alias("n_original"))
    hit = hit.join(_sorted(seen), F.col("of") == F.col("own")).join(_sorted(vocabulary.select("h", "token")), "h")
    two_way = F.col("chain").isin(TWO_WAY)
    hit = hit.where(~two_way | (F.col("n_original") > 2 * F.col("n"))).select("token", "original", "chain", "n", "n_original")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [(t, c) in forms(o) for t, o, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_()))

    return space.write(hit.mapInArrow(verify, "token string, original string, chain int, n long, n_original long"), "garbled")


def _flagged(documents: DataFrame) -> tuple[Workspace, DataFrame, DataFrame, DataFrame]:
    """The workspace, the documents, the garbled tokens with their originals, and doc_id of the documents affected."""
    space = Workspace(documents.sparkSession, "mojibake")
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    tokens = _tokens(docs)
    garbled = _garbled_vocabulary(space, tokens)
    flagged_words = garbled.select("token").distinct().select(F.xxhash64("token").alias("h"))
    by_word = tokens.select("doc_id", F.xxhash64("token").alias("h")).join(_sorted(flagged_words), "h", "left_semi").select("doc_id")

    @F.pandas_udf(T.BooleanType())
    def looks(text: pd.Series) -> pd.Series:
        p = character_forms()
        return text.map(lambda t: not t.isascii() and p.search(t) is not None).astype(bool)

    other = docs.where(F.col("text").rlike(r"[^\x00-\x7F]")).where(F.col("text").rlike(RESIDUE) | looks(F.col("text"))).select("doc_id")
    return space, docs, garbled, by_word.union(other).distinct()


def garbled_documents(documents: DataFrame) -> DataFrame:
    """doc_id of the documents that hold garbled characters, restorable or not.

    Found by the join of the documents' tokens with the garbled forms of the corpus's words; then also by characters that
    only a wrong decoding leaves behind, and by sequences that UTF-8's lead and continuation bytes leave when read one by
    one, for words that occur nowhere undamaged. Documents without text or id aren't affected; repeated rows give one;
    an empty table gives no rows; other columns aren't read.
    """
    return _flagged(documents)[3]


def ungarble(text: str, chain: int) -> str | None:
    """The text before a chain garbled it; None if its bytes say it wasn't."""
    if chain >= len(WRONG_READINGS):
        a, b = TWICE[chain - len(WRONG_READINGS)]
        once = ungarble(text, b)
        return None if once is None else ungarble(once, a)
    true, read = WRONG_READINGS[chain]
    data = _write(text, read) if read != "utf-8" else None  # what failed as UTF-8 has lost its bytes
    if data is None:
        return None
    try:
        out = data.decode(true)
    except UnicodeDecodeError:
        return None
    return out if out != text else None


def _damage(text: str) -> int:
    return len(re.findall("[�\u0080-\u0084\u0086-\u009f-]", text)) + len(character_forms().findall(text))


def restore_text(text: str, words: dict[str, str], chains: list[int], bad: set[str]) -> str:
    """Lines are read back under the document's chains where the whole line's bytes allow it and damage vanishes; then
    single tokens are replaced by their originals."""
    out = []
    for line in text.split("\n"):
        if not line.isascii():
            hurt = sum(t in bad for t in _TOKEN.findall(line)) + _damage(line)
            for chain in chains:
                if hurt and (back := ungarble(line, chain)) is not None:
                    left = sum(t in bad for t in _TOKEN.findall(back)) + _damage(back)
                    if left < hurt:
                        line, hurt = back, left
            if hurt:
                line = _TOKEN.sub(lambda m: words.get(m.group(), m.group()), line)
        out.append(line)
    return "\n".join(out)


def restored_documents(documents: DataFrame) -> DataFrame:
    """The affected documents: doc_id, text (restored where possible), fully_restored.

    A garbled token's original is the corpus word whose garbled form it is; of several the most frequent, and none where
    the form has lost the difference (replacement characters) and several words fit. Originals that are garbled themselves
    are followed further. The chains met in a document also restore lines whose words occur nowhere else. See
    `garbled_documents` for nulls and repeated rows; a repeated doc_id keeps each of its different texts.
    """
    space, docs, garbled, found = _flagged(documents)
    found = space.write(found, "found")
    lossy = F.col("token").contains("�")
    best = garbled.groupBy("token").agg(
        F.max(F.struct(F.col("chain") >= 0, "n_original", -F.col("chain"), "original")).alias("m"), F.countDistinct("original").alias("k")
    )
    best = best.where(~(lossy & (F.col("k") > 1)) & (F.col("m.col1")))
    best = space.write(best.select("token", F.col("m.original").alias("original"), (-F.col("m.col3")).alias("chain")), "originals")
    left = -1
    while True:  # an original may be garbled itself; each round looks twice as far, until nobody is left or none got further
        further = best.select(F.col("token").alias("original"), F.col("original").alias("next"))
        both = best.join(_sorted(further), "original", "left").withColumn("next", F.when(F.col("next") != F.col("token"), F.col("next")))
        best = space.write(both.select("token", F.coalesce("next", "original").alias("original"), "chain", F.col("next").isNotNull().alias("moved")), "originals")
        left, before = best.where("moved").count(), left
        best = best.select("token", "original", "chain")
        if left in (0, before):
            break
    best = best.withColumn("h", F.xxhash64("token"))
    tokens = _tokens(docs.join(found, "doc_id", "left_semi")).withColumn("h", F.xxhash64("token"))
    per_doc = tokens.join(_sorted(best.select("h", "original", "chain")), "h").groupBy("doc_id").agg(
        F.collect_set(F.struct("token", "original", "chain")).alias("known")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, whole = [], []
            for text, known in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                known = known or []
                words = {k["token"]: k["original"] for k in known}
                votes: dict[int, int] = {}
                for k in known:
                    votes[k["chain"]] = votes.get(k["chain"], 0) + 1
                chains = sorted(votes, key=lambda c: (-votes[c], c))
                chains += [c for c in range(len(WRONG_READINGS) + len(TWICE)) if c not in votes and (c >= len(WRONG_READINGS) or WRONG_READINGS[c][0] == "utf-8")]
                out = restore_text(text, words, chains, set(words))
                texts.append(out)
                whole.append(not _damage(out) and not any(t in words for t in _TOKEN.findall(out)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(whole)], names=["doc_id", "text", "fully_restored"])

    affected = docs.join(found, "doc_id", "left_semi").join(per_doc, "doc_id", "left").select("doc_id", "text", "known")
    return affected.mapInArrow(run, "doc_id long, text string, fully_restored boolean").distinct()
