"""URL expressions. Malformed URLs give nulls or empty parts, never errors; nulls stay null unless stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"

# File name endings of pages that aren't HTML.
NON_HTML_EXTENSIONS = (
    [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".tar", ".gz", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".mp4", ".mp3", ".avi", ".mov"]
)
# Parts of an address that mark pages of no interest.
BAD_PARTS = ["news", "event", "blog", "login", "contact", "about", "staff", "library"]
# Host endings and countries, first match wins; the short and the long list.
COUNTRIES_SHORT = [("UK", (".uk",)), ("US", (".edu", ".gov")), ("JP", (".jp",))]
COUNTRIES_LONG = [*COUNTRIES_SHORT, ("AU", (".au",)), ("NZ", (".nz",)), ("IE", (".ie",)), ("CA", (".ca",))]
# Domains that are no seeds.
BLOCKED_DOMAINS = (
    ["wikipedia.org", "facebook.com", "x.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "zoominfo.com", "tiktok.com", "kotobank.jp"]
)
# Host names of universities with a known name, first match wins; host labels that name no university.
KNOWN_HOSTS = {
    "study.ed.ac.uk": "University of Edinburgh",
    "ed.ac.uk": "University of Edinburgh",
    "athabascau.ca": "Athabasca University",
    "open.ac.uk": "The Open University",
    "london.ac.uk": "University of London",
    "ignou.ac.in": "Indira Gandhi National Open University",
}
GENERIC_LABELS = ["www", "study", "apply", "admissions", "courses", "portal"]
# Marks of pages about courses' surroundings rather than courses.
EXCLUDED_MARKERS = [
    "scholarship", "bursar", "funding", "fellowship", "graduation", "alumni", "student guide", "support-wellbeing",
    "support and wellbeing", "recognition-prior-learning", "recognition of prior learning", "how-apply", "how to apply",
    "where-study", "where to study", "why-study-us", "why study with us", "on the day", "after-graduation",
    "after graduation", "am-qualified", "am i qualified", "costs-course", "costs of your course", "current-students",
    "student-services", "taster-courses", "benefits",
]
LISTING_PATHS = [
    "/programmes", "/programmes/undergraduate", "/programmes/postgraduate-taught", "/programmes/postgraduate-research",
    "/study/courses", "/study/courses/undergraduate", "/study/courses/postgraduate", "/study/courses/research-degree",
]
# Words that mark sitemap addresses worth a visit first.
SITEMAP_WORDS = ["program", "programme", "course", "degree", "study", "tuition", "fee", "undergraduate", "postgraduate", "master", "bachelor", "phd"]


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def authority(url: Column) -> Column:
    """Host with port and user info, as written; empty without //."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def netloc(url: Column) -> Column:
    return F.lower(authority(url))


def path(url: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(url, _AUTHORITY, ""), r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    return F.regexp_extract(rest, r"^([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def bare(url: Column) -> Column:
    """The lower-case address without query and fragment."""
    return F.regexp_extract(F.lower(url), r"^([^?#]*)", 1)


def root_url(url: Column) -> Column:
    """scheme://authority, https where no scheme is given; empty without an authority."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = authority(url)
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.when(scheme == "", F.lit("https")).otherwise(scheme), F.lit("://"), host))


def is_absolute_http(url: Column) -> Column:
    u = F.trim(url)
    host = authority(u)
    return F.coalesce(u.rlike(r"(?i)^https?://") & (host != "") & ~host.contains("*"), F.lit(False))


def domain(url: Column) -> Column:
    """What stands before the first slash after the scheme, in lower case; also for addresses without a scheme."""
    return F.lower(F.split_part(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://", ""), F.lit("/"), F.lit(1)))


def without_www(domain_name: Column) -> Column:
    return F.lower(F.regexp_replace(domain_name, r"^www\.", ""))


def logged_domain(url: Column) -> Column:
    """The text between // and the next slash; empty without //."""
    return F.split_part(F.split_part(url, F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))


def canonical(url: Column) -> Column:
    """Lower case, without fragment, query, a year as a path step, and slashes at the end."""
    x = F.lower(strip(url))
    x = F.regexp_replace(F.regexp_replace(x, "(?s)#.*", ""), r"(?s)\?.*", "")
    return F.regexp_replace(F.regexp_replace(x, r"/20\d{2}/", "/"), r"/+\z", "")


def country(url: Column, endings=COUNTRIES_SHORT) -> Column:
    host = netloc(url)
    out = F.lit("unknown")
    for code, suffixes in reversed(list(endings)):
        out = F.when(any_of([host.endswith(s) for s in suffixes]), F.lit(code)).otherwise(out)
    return out


def title_case(text: Column) -> Column:
    """Each run of letters capitalised, wherever it stands: ed-ac -> Ed-Ac. initcap knows only white space."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def university_name(url: Column, known: Mapping[str, str] = KNOWN_HOSTS, generic: Sequence[str] = GENERIC_LABELS) -> Column:
    """The known name of a host, else its first label that isn't generic, in title case."""
    host = netloc(url)
    labels = F.filter(F.split(host, r"\."), lambda x: (x != "") & ~x.isin(*generic))
    out = F.when(F.size(labels) > 0, title_case(F.get(labels, F.lit(0)))).otherwise(title_case(host))
    for part, name in reversed(list(known.items())):
        out = F.when(host.contains(part), F.lit(name)).otherwise(out)
    return out


def scope_path(url: Column) -> Column:
    p = F.regexp_replace(path(url), "/+$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def in_scope(url: Column, scope: Column) -> Column:
    """Same host, and the path is the scope's or below it; a scope without path takes the whole host."""
    s, p = scope_path(scope), scope_path(url)
    return (authority(url) == authority(scope)) & ((s == "/") | (p == s) | p.startswith(F.concat(s, F.lit("/"))))


def is_non_html(url: Column, extensions: Sequence[str] = NON_HTML_EXTENSIONS) -> Column:
    return any_of([bare(url).endswith(e) for e in extensions])


def is_filtered(url: Column, parts: Sequence[str] = BAD_PARTS) -> Column:
    """Not HTML, or one of the parts occurs in the address (host included)."""
    return is_non_html(url) | any_of([bare(url).contains(p) for p in parts])


def is_excluded_page(url: Column, title: Column) -> Column:
    """Numbered result pages, listing pages, searches over listings, and pages whose title or path has a marker."""
    p = F.regexp_replace(F.lower(path(url)), "/+$", "")
    q = F.lower(query(url))
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), path(url)))
    listing = q.contains("query=") & (p.contains("/programmes") | p.contains("/study/courses"))
    return q.contains("page=") | p.isin(*LISTING_PATHS) | listing | any_of([text.contains(m) for m in EXCLUDED_MARKERS])


def is_blocked(domain_name: Column, blocked: Sequence[str] = BLOCKED_DOMAINS) -> Column:
    """The domain is one of the blocked ones or lies under one."""
    d = F.lower(F.trim(F.coalesce(domain_name, F.lit(""))))
    return any_of([(d == b) | d.endswith("." + b) for b in blocked])


def seen_key(url: Column) -> Column:
    return F.concat(F.lit("seen:"), F.sha1(url))


def priority_urls(urls: Column, limit: int, words: Sequence[str] = SITEMAP_WORDS) -> Column:
    """The first `limit` different urls of an array with one of the words."""
    hit = F.filter(F.array_distinct(urls), lambda u: any_of([F.lower(u).contains(w) for w in words]))
    return F.slice(hit, 1, limit)


def root_urls(*arrays_and_urls: Column) -> Column:
    """The different root urls of some arrays of urls, in order, without empty ones."""
    roots = F.transform(F.concat(*arrays_and_urls), lambda u: root_url(u))
    return F.array_distinct(F.filter(roots, lambda r: r.isNotNull() & (r != "")))
