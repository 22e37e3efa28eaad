"""Text, number and JSON expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkademia.functions.urls import any_of, netloc, path

# Subjects and their keywords.
COURSE_KEYWORDS: dict[str, list[str]] = {
    "computer_science": ["computer science", "informatics", "computing", "software", "programming", "ai", "artificial intelligence", "machine learning", "data science", "cybersecurity", "information systems", "情報", "データ", "計算機", "ソフトウェア", "人工知能", "機械学習", "情報科学"],
    "engineering": ["engineering", "mechanical", "electrical", "electronic", "civil", "chemical engineering", "aerospace", "robotics", "materials", "industrial engineering", "工学", "機械", "電気", "電子", "土木", "化学工学", "材料", "ロボティクス"],
    "business": ["business", "management", "finance", "mba", "accounting", "marketing", "economics and management", "entrepreneurship", "international business", "経営", "会計", "ビジネス", "ファイナンス", "マーケティング"],
    "health": ["medicine", "medical", "nursing", "public health", "pharmacy", "biomedical", "clinical", "dentistry", "看護", "医学", "医療", "公衆衛生", "薬学", "歯学"],
    "education": ["education", "teaching", "pedagogy", "curriculum", "teacher training", "educational", "教育", "教職", "教育学"],
    "law": ["law", "legal", "jurisprudence", "llb", "llm", "法学", "法律", "司法"],
    "social_science": ["psychology", "sociology", "politics", "political science", "economics", "international relations", "anthropology", "public policy", "社会", "心理", "経済", "政治", "国際関係", "社会学"],
    "humanities": ["history", "philosophy", "literature", "language", "linguistics", "classics", "religion", "人文", "文学", "哲学", "歴史", "言語", "言語学"],
    "science": ["biology", "chemistry", "physics", "mathematics", "science", "environmental science", "geology", "statistics", "生物", "化学", "物理", "数学", "理学", "統計", "地学", "環境科学"],
    "arts_design": ["art", "design", "music", "fine art", "architecture", "media", "film", "theatre", "芸術", "デザイン", "音楽", "建築", "メディア", "映像", "演劇"],
}
# Which subject wins when all scores are equal.
COURSE_PRIORITY = ["computer_science", "engineering", "health", "business", "law", "education", "social_science", "science", "humanities", "arts_design"]
# Levels and what marks them, first match wins.
DEGREE_LEVELS = [
    ("PhD", ["phd", "doctorate", "博士"]),
    ("Bachelor", ["bachelor", "undergraduate", "bsc", "beng", "ba ", "学士"]),
    ("Master", ["master", "postgraduate", "graduate", "msc", "meng", "ma ", "修士"]),
]
# Fee wordings, first match wins: type, months, note.
FEE_RULES = [
    (("per credit", "/credit"), "per_credit", None, "per_credit_not_normalized"),
    (("per course", "/course"), "per_course", None, "per_course_not_normalized"),
    (("per month", "/month", "monthly"), "fixed_month", 1, "monthly_as_is"),
    (("per semester", "/semester"), "fixed_semester", 6, "semester_div_6"),
    (("per year", "/year", "annual"), "fixed_year", 12, "yearly_div_12"),
    (("total", "full program"), "total", None, "total_not_normalized"),
]
FEE_RANGE = r"[0-9].{0,10}(-|–|to).{0,10}[0-9]"
# Words for a missing value.
NULL_WORDS = ["none", "null", "nan", "n/a", "na", "-"]
# Course and contrary hints, academic host endings.
COURSE_HINTS = ["course", "courses", "program", "programmes", "degree", "degrees", "undergraduate", "postgraduate", "study", "academics"]
CONTRARY_HINTS = ["news", "event", "blog", "ranking", "rankings", "wikipedia", "linkedin", "facebook", "x.com", "twitter"]
ACADEMIC_ENDINGS = (".edu", ".ac.uk", ".ac.jp", ".edu.au")
GENERIC_NAME_WORDS = ["university", "college", "institute", "school"]
BOT_MARKERS = ["captcha", "cloudflare", "verify you are human", "are you human", "access denied", "bot detection"]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return any_of([text.contains(w) for w in words])


def program_name(title: Column) -> Column:
    """The text before the first " - ", trimmed."""
    return F.trim(F.split_part(title, F.lit(" - "), F.lit(1)))


def wall_clock(text: Column) -> Column:
    """An ISO time as 'yyyy-MM-dd HH:mm:ss' in its own offset, without converting; any other text unchanged."""
    pattern = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?$"
    t = F.concat_ws(" ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
    return F.when(text.rlike(pattern) & F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull(), t).otherwise(text)


def degree_level(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.lit("Other")
    for level, words in reversed(DEGREE_LEVELS):
        out = F.when(contains_any(low, words), F.lit(level)).otherwise(out)
    return out


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _quoted(word: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " and ch.isascii() else ch for ch in word)


def keyword_hits(text: Column, word: str) -> Column:
    """How often a keyword occurs, without overlaps: as whole words if it has Latin letters, else anywhere."""
    w = _quoted(word.lower())
    pattern = rf"(?U)\b{w}\b" if any("a" <= ch <= "z" for ch in word.lower()) else w
    low = F.lower(text)
    return F.when(low.contains(word.lower()), F.regexp_count(low, F.lit(pattern))).otherwise(0)  # most texts lack most words


def course_type(
    primary: Column,
    secondary: Column | None = None,
    heading: Column | None = None,
    tag_scores: Mapping[str, Column] | None = None,
    keywords: Mapping[str, Sequence[str]] = COURSE_KEYWORDS,
) -> Column:
    """The subject with the highest score: what its keywords score in tags, plus 5 a hit in headings, 3 in the text itself
    and 1 in the page; `general` if none scores. Ties go by tag, heading, text and page score, then by priority: one
    maximum over structs."""
    rows = []
    for name, words in keywords.items():
        count = lambda c: sum((keyword_hits(c, w) for w in words), F.lit(0)) if c is not None else F.lit(0)  # noqa: B023, E731
        tag = (tag_scores or {}).get(name, F.lit(0)).cast("long")
        h, p, s = count(heading).cast("long"), count(primary).cast("long"), count(secondary).cast("long")
        rank = COURSE_PRIORITY.index(name) if name in COURSE_PRIORITY else len(COURSE_PRIORITY)
        rows.append(F.struct((tag + 5 * h + 3 * p + s).alias("score"), tag.alias("tag"), h.alias("h"), p.alias("p"), s.alias("s"), F.lit(-rank).alias("r"), F.lit(name).alias("name")))
    zero = F.lit(0).cast("long")
    none = F.struct(zero.alias("score"), zero.alias("tag"), zero.alias("h"), zero.alias("p"), zero.alias("s"), F.lit(1).alias("r"), F.lit("general").alias("name"))
    return F.array_max(F.array(*rows, none)).getField("name")


def fee_class(line: Column) -> Column:
    """struct(tuition_type, months, note) of a line's wording; first rule that matches."""
    low = F.lower(line)
    make = lambda t, m, n: F.struct(F.lit(t).alias("tuition_type"), F.lit(m).cast("int").alias("months"), F.lit(n).alias("note"))
    out = make("unknown", None, "unknown_not_normalized")
    for words, *value in reversed(FEE_RULES):
        out = F.when(contains_any(low, words), make(*value)).otherwise(out)
    return F.when(low.rlike(FEE_RANGE), make("range", None, "range_not_normalized")).otherwise(out)


def amounts(line: Column) -> Column:
    """The numbers of a line that have thousands separators or four digits and more."""
    return F.transform(
        F.regexp_extract_all(line, F.lit(r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{4,})"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("bigint")
    )


def amount_range(line: Column) -> Column:
    """struct(low, high) of a line with two amounts or more that aren't years of this century; nulls otherwise."""
    kept = F.filter(amounts(line), lambda v: ~v.between(2000, 2099))
    two = F.size(kept) >= 2
    return F.struct(F.when(two, F.array_min(kept)).alias("low"), F.when(two, F.array_max(kept)).alias("high"))


def is_missing(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return text.isNull() | (low == "") | low.isin(*NULL_WORDS)


def parse_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "t", "yes", "y"), F.lit(False))


def parse_float(text: Column) -> Column:
    return F.when(~is_missing(text), text.try_cast("double"))


def parse_timestamp(text: Column) -> Column:
    return F.when(~is_missing(text), F.try_to_timestamp(text))


def to_int(text: Column, default: int = 0) -> Column:
    """int(float(text)), or the default for what isn't a number."""
    return F.coalesce(text.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def json_strings(text: Column) -> Column:
    """A JSON array of texts, in double or single quotes; an empty array for anything else."""
    return F.coalesce(F.from_json(F.trim(text), "array<string>", {"allowSingleQuotes": "true"}), F.array().cast("array<string>"))


def has_fatal(errors: Column, words: Sequence[str]) -> Column:
    """Whether one of the words occurs in any error of an array, ignoring case."""
    return F.exists(F.coalesce(errors, F.array().cast("array<string>")), lambda e: contains_any(F.lower(e), [w.lower() for w in words]))


def weighted_flags(flags: Sequence[tuple[str, Column, float]]) -> tuple[Column, Column]:
    """(score, reasons): the weights of the flags that hold, added up, and their names joined by '; '."""
    score = sum((F.when(c, F.lit(w)).otherwise(F.lit(0)) for _, c, w in flags), F.lit(0))
    return score, F.concat_ws("; ", *[F.when(c, F.lit(n)) for n, c, _ in flags])


def name_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)


def domain_bonus(domain: Column, names: Column, weight: float = 0.8, generic: Sequence[str] = GENERIC_NAME_WORDS) -> Column:
    """`weight` for each word of the names that occurs in the domain, generic words aside."""
    words = F.flatten(F.transform(names, lambda n: name_tokens(n)))
    hits = F.filter(words, lambda t: ~t.isin(*generic) & F.contains(F.lower(domain), t))
    return F.size(hits) * F.lit(weight)


def course_like_score(url: Column, title: Column, snippet: Column, query: Column) -> Column:
    """How much a search hit looks like a page about courses."""
    combined = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    asked = (F.length(query) > 0) & F.contains(combined, F.lower(query))
    flags = [
        ("path", contains_any(F.lower(path(url)), COURSE_HINTS), 4.0),
        ("text", contains_any(combined, COURSE_HINTS), 2.0),
        ("query", F.coalesce(asked, F.lit(False)), 2.0),
        ("academic", any_of([netloc(url).endswith(e) for e in ACADEMIC_ENDINGS]), 1.5),
        ("contrary", contains_any(combined, CONTRARY_HINTS), -3.0),
    ]
    return weighted_flags(flags)[0]


def page_signals(url: Column, title: Column, snippet: Column, html: Column) -> Column:
    """struct(search_form, course_list, bonus) of a fetched page, by the whole of its html."""
    text = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")), F.coalesce(html, F.lit(""))))
    form = F.contains(F.lower(F.coalesce(html, F.lit(""))), F.lit("<form")) & contains_any(text, ["search", "finder", "filter", "query"])
    hits = sum((F.when(text.contains(w), 1).otherwise(0) for w in COURSE_HINTS), F.lit(0))
    p = F.lower(path(url))
    listing = (hits >= 2) | p.contains("/program") | p.contains("/course")
    return F.struct(form.alias("search_form"), listing.alias("course_list"), (F.when(form, 1.0).otherwise(0.0) + F.when(listing, 3.0).otherwise(0.0)).alias("bonus"))


def run_config(label: Column) -> Column:
    """A run's label without its number."""
    return F.regexp_replace(label, r"-run\d+$", "")


def is_scripted_failure(status: Column) -> Column:
    """A status that isn't a number, or is 400 or more."""
    return ~status.rlike("^[0-9]+$") | (status.try_cast("int") >= 400)


def fetch_method(log: Column, fallback: Column) -> Column:
    """The client that fetched a page: requests after a fallback, else the first that succeeded, else the last that tried,
    else unknown. log: array of struct(client, ok)."""
    ok = F.filter(log, lambda x: x["ok"])
    last = F.element_at(F.transform(log, lambda x: x["client"]), -1)
    return F.when(fallback, F.lit("requests")).when(F.size(ok) > 0, F.get(ok, F.lit(0))["client"]).when(F.size(log) > 0, F.coalesce(last, F.lit("unknown"))).otherwise(F.lit("unknown"))


def site_class(text: Column, blocked: Sequence[str] = BOT_MARKERS, script_only: Sequence[str] = ("enable javascript",), words: Sequence[str] = COURSE_HINTS, least: int = 2000) -> Column:
    """Whether a site's page can be used: BLOCKED, JS_ONLY, EMPTY or OK."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(contains_any(low, blocked), "BLOCKED").when(contains_any(low, script_only), "JS_ONLY").when(F.length(low) < least, "EMPTY").when(contains_any(low, words), "OK").otherwise("EMPTY")
    )


def discovery_queries(name: Column, limit: int = 3) -> Column:
    """Search phrases for a university's name; the name's own language first."""
    n = F.trim(name)
    japanese = n.rlike(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]")
    make = lambda *parts: F.array(*[F.concat(n, F.lit(" " + p)) for p in parts])
    phrases = F.when(japanese, make("公式", "official", "official site")).otherwise(make("official", "official site", "公式"))
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.slice(phrases, 1, limit))


