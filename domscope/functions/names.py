"""Functions of domain names and organization names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the name patterns, the stop words of keywords.
LOGIN_WORDS = ("login", "signin", "signon", "auth", "authenticate", "authentication", "account", "password")
SECURITY_WORDS = ("secure", "security", "verify", "verification", "confirm", "token", "otp", "2fa")
UPDATE_WORDS = ("update", "upgrade", "renew", "refresh", "patch")
SERVICE_WORDS = ("service", "portal", "mail", "email", "support", "cloud", "office", "web")
KEYWORD_STOPS = ("com", "net", "org", "www")


def normal_domain(c: Column) -> Column:
    """Trimmed, lower case, without scheme, and without what follows the host; no dots at the ends."""
    bare = F.regexp_replace(F.lower(F.trim(c)), "^[a-z]+://", "")
    return F.btrim(F.regexp_extract(bare, "^[^/?#:]*", 0), F.lit("."))


def labels(domain: Column) -> Column:
    """The labels of a domain, without empty ones."""
    return F.filter(F.split(domain, "[.]"), lambda x: x != "")


def sld(domain: Column) -> Column:
    """The label before the last; the only label, if there is one; empty without any."""
    x = labels(domain)
    return F.when(F.size(x) >= 2, F.try_element_at(x, F.lit(-2))).otherwise(F.coalesce(F.try_element_at(x, F.lit(1)), F.lit("")))


def tld(domain: Column) -> Column:
    """The last label of two or more; else empty."""
    x = labels(domain)
    return F.when(F.size(x) >= 2, F.try_element_at(x, F.lit(-1))).otherwise(F.lit(""))


def domain_tokens(domain: Column) -> Column:
    """The parts between hyphens, underscores, dots and digits."""
    return F.filter(F.split(domain, r"[-_.0-9]+"), lambda x: x != "")


def text_tokens(c: Column) -> Column:
    """Lower-case parts between hyphens, underscores, dots, digits and white space."""
    return F.filter(F.split(F.lower(c), r"[-_.0-9\s]+"), lambda x: x != "")


def char_grams(c: Column, n: int = 3) -> Column:
    """The set of n-grams of the trimmed lower-case text; the text itself if it is shorter."""
    t = F.lower(F.trim(c))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(F.char_length(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def _any(tokens: Column, words: Iterable[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def pattern_score(tokens: Column) -> Column:
    """How much the words of a name look like an imitated login page."""
    t = F.transform(tokens, lambda x: F.lower(F.trim(x)))
    login, security, update, service = (_any(t, w) for w in (LOGIN_WORDS, SECURITY_WORDS, UPDATE_WORDS, SERVICE_WORDS))
    scores = [(service & login & security, 0.9), (service & login & update, 0.85), (login & security, 0.6)]
    out = F.lit(0.0)
    for test, value in reversed(scores):
        out = F.when(test, F.lit(value)).otherwise(out)
    return out


def domain_keywords(domains: Column) -> Column:
    """Sorted keywords of an array of domains: parts of all labels but the last, of 3 letters or more, without
    stop words."""
    stems = F.transform(domains, lambda d: F.array_join(F.slice(F.split(F.lower(F.trim(d)), "[.]"), 1, F.greatest(F.size(F.split(d, "[.]")) - 1, F.lit(0))), "."))
    parts = F.flatten(F.transform(stems, lambda s: F.split(s, r"[-_.0-9]+")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda w: (F.char_length(w) >= 3) & ~w.isin(*KEYWORD_STOPS))))


def domain_tlds(domains: Column) -> Column:
    """The sorted last labels of the domains of two labels or more."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(domains, lambda d: tld(F.lower(F.trim(d)))), lambda t: t != "")))


def key_domain(c: Column) -> Column:
    """Lower case without dots."""
    return F.replace(F.lower(c), F.lit("."), F.lit(""))


#: The most edits that edit_bound() allows.
MOST_EDITS = 6


def edits_of_length(n: Column) -> Column:
    """The edits allowed for a key of n characters: half of them, 2 to 6."""
    return F.greatest(F.lit(2), F.least(F.lit(MOST_EDITS), F.floor(n / 2).cast("int")))


def edit_bound(key: Column) -> Column:
    """The edits allowed for a key."""
    return edits_of_length(F.char_length(key))


def similarity_bound(key: Column, override: float | None = None) -> Column:
    """The similarity to be exceeded: stricter for short keys."""
    n = F.char_length(key)
    return F.lit(override) if override is not None else F.when(n <= 4, 0.92).when(n <= 6, 0.88).otherwise(0.85)


def within_edits(a: Column, b: Column, bound: Column) -> Column:
    """Whether the edit distance is at most the bound."""
    return (F.abs(F.char_length(a) - F.char_length(b)) <= bound) & (F.levenshtein(a, b) <= bound)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def normal_organization(c: Column) -> Column:
    """Trimmed, lower case, without white space, hyphens and underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "")


def valid_domain(c: Column) -> Column:
    """Whether the text has the form of a domain name."""
    return c.rlike(r"(?i)^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$")
