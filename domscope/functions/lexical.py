"""The lexical feature vector of a domain name: 25 numbers in a fixed order.

The name is taken as it is. Parts are what hyphens, dashes, dots and underscores separate, the last label
included. Words are the parts of at most 7 characters, and for longer parts what a segmenter makes of
them without their digits; by default that is one word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Well-known endings, and the words whose edit distance is measured, in order.
KNOWN_TLDS = ("com", "org", "net", "gov", "edu")
EDIT_WORDS = ("gov", "pk", "mail", "serve")
MOST_EDITS = 20
LONG_PART = 7
# The longest word looked for, and what stands before a first word.
LONGEST_WORD, START = 24, "<s>"
NAMES = (
    "sld_length", "tld_length", "rest_length", "sub_labels", "doubled_chars", "hyphens", "digits", "rest_digits", "known_tld",
    "parts", "part_mean", "part_max", "part_min", "part_std", "edit_gov", "edit_pk", "edit_mail", "edit_serve", "words", "split_parts", "split_mean",
    "entropy", "has_www", "has_com", "gov_count",
)


def one_word(parts: Column) -> Column:
    """The segmenter that leaves each part as one word."""
    return F.transform(parts, lambda p: F.array(p))


def segmented(text: str, words: Mapping[str, float], pairs: Mapping[str, float], total: float) -> list[str]:
    """The words that a text most likely is made of. A word has the chance that its count gives, or its count after
    the one before it, if ``pairs`` has "before word"; unknown words are the less likely the longer they are."""
    t = re.sub("[^a-z0-9]", "", text.lower())

    def chance(word: str, before: str | None) -> float:
        known = words.get(word)
        alone = math.log10(known / total) if known else 1 - math.log10(total) - len(word)
        pair = pairs.get(f"{before} {word}") if before in words else None
        return math.log10(pair / words[before]) if pair else alone

    # best[j][i]: the best way to t[:j] whose last word is t[i:j], as its score and where the word before starts
    best: list[dict[int, tuple[float, int]]] = [{0: (0.0, 0)}] + [{} for _ in t]
    for j in range(1, len(t) + 1):
        for i in range(max(0, j - LONGEST_WORD), j):
            before = [(score + chance(t[i:j], t[h:i] if i else START), h) for h, (score, _) in best[i].items()]
            best[j][i] = max(before, key=lambda x: (x[0], -x[1]))
    out, j = [], len(t)
    i = max(best[j], key=lambda k: (best[j][k][0], -k)) if j else 0
    while j:
        out.append(t[i:j])
        i, j = best[j][i][1], i
    return out[::-1]


def dictionary_segmenter(words: Mapping[str, float], pairs: Mapping[str, float] | None = None, total: float | None = None) -> Callable[[Column], Column]:
    """A segmenter by counts of words, and of pairs "before word" (START before a first word). The counts travel with
    the function to every worker, so they are a dictionary, some 100 000 entries, and not a table that grows."""
    whole = total or float(sum(words.values()))
    known, follow = dict(words), dict(pairs or {})

    @F.pandas_udf("array<array<string>>")
    def segment(column: pd.Series) -> pd.Series:
        return column.map(lambda parts: None if parts is None else [segmented(p, known, follow, whole) for p in parts])

    return segment


def _sum(c: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda t, x: t + of(x))


def _digits(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Nd}"))


def _least(words: Column, word: str) -> Column:
    return F.least(F.lit(MOST_EDITS), F.coalesce(F.array_min(F.transform(words, lambda w: F.levenshtein(w, F.lit(word)))), F.lit(MOST_EDITS)))


def _bare(part: Column) -> Column:
    return F.regexp_replace(part, r"\p{Nd}+", "")


def _long_parts(domain: Column) -> Column:
    """The long parts that aren't all digits."""
    return F.filter(F.split(domain, "[-—._]", -1), lambda p: (F.char_length(p) > LONG_PART) & (_bare(p) != ""))


def segments(domain: Column, segment: Callable[[Column], Column] = one_word) -> Column:
    """The words of each long part without its digits. ``segment`` maps an array of parts to one of arrays of words."""
    return segment(F.transform(_long_parts(domain), _bare))


def features(domain: Column, words: Column | None = None) -> list[Column]:
    """The 25 columns, named as in NAMES, all double. ``words`` are the domain's segments(): by default each part is a
    word; others have to be a column of the frame, as functions in Python can't be part of these expressions."""
    split_words = segments(domain) if words is None else words
    labels = F.split(domain, "[.]", -1)
    n = F.size(labels)
    several = n >= 2
    main, last = F.try_element_at(labels, F.lit(-2)), F.try_element_at(labels, F.lit(-1))
    rest = F.slice(labels, 1, F.greatest(n - 2, F.lit(0)))
    rest_digits = _sum(rest, lambda x: _digits(x))
    parts = F.split(domain, "[-—._]", -1)
    lengths = F.transform(parts, lambda p: F.char_length(p).cast("double"))
    size = F.size(parts)
    mean = _sum(lengths, lambda x: x) / size
    before_last = F.slice(parts, 1, size - 1)
    long_parts = _long_parts(domain)
    long_words = F.flatten(split_words)
    # A part counts as split if what is left without its digits has several words; its own length is meant.
    split_parts = F.filter(long_parts, lambda p, i: F.size(F.get(split_words, i)) > 1)
    chars = F.filter(F.split(domain, ""), lambda c: c != "")
    count = F.char_length(domain)
    share = lambda c: (F.size(F.filter(chars, lambda x: x == c)) / count).cast("double")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda t, c: t - share(c) * F.log2(share(c)))
    doubled = F.array_distinct(F.filter(chars, lambda c, i: c == F.get(chars, i + 1)))
    both = F.concat(before_last, long_words)
    values = [
        F.when(several, F.char_length(main)).otherwise(0),
        F.when(several, F.char_length(last)).otherwise(0),
        F.when(several, _sum(rest, lambda x: F.char_length(x))).otherwise(0),
        F.greatest(n - 2, F.lit(0)),
        F.size(doubled),
        F.regexp_count(domain, F.lit("[-—]")),
        F.when(several, _digits(main) + rest_digits).otherwise(F.when(domain.rlike(r"^\p{Nd}+$"), 1).otherwise(0)),
        F.when(several, rest_digits).otherwise(0),
        last.isin(*KNOWN_TLDS).cast("int"),
        size,
        mean,
        F.array_max(lengths),
        F.array_min(lengths),
        F.sqrt(_sum(lengths, lambda x: (x - mean) * (x - mean)) / size),
        *[_least(both, w) for w in EDIT_WORDS],
        F.size(F.filter(parts, lambda p: F.char_length(p) <= LONG_PART)) + F.size(long_words),
        F.size(split_parts),
        F.when(F.size(split_parts) > 0, _sum(split_parts, lambda p: F.char_length(p)) / F.greatest(F.size(split_parts), F.lit(1))).otherwise(0),
        entropy,
        F.exists(before_last, lambda p: F.contains(p, F.lit("www"))).cast("int"),
        F.exists(before_last, lambda p: F.contains(p, F.lit("com"))).cast("int"),
        _sum(before_last, lambda p: F.regexp_count(p, F.lit("gov"))),
    ]
    return [v.cast("double").alias(name) for v, name in zip(values, NAMES)]
