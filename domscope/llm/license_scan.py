"""Short licence notices in texts, also misspelt ones: pigeonhole seeds, then bounded-error matching.

A text is its words (A-Z lower-cased) with single spaces between, before and behind them, and so is a notice's phrase. A phrase that may have
k edits (characters put in, left out or changed) is cut in k + 1 pieces: wherever it stands with at most k edits, one of
its pieces stands unchanged. One automaton finds the pieces of all phrases in a text. Around each, in a window as wide as the
phrase and k edits on either side, the regex library looks for the place with the fewest edits; words that tell one licence from
another (``fixed``: names, version numbers) have to stand unchanged. What a window gives is remembered for the same window,
so a text that is full of pieces takes time in proportion to its length.

A place without edits is exact: the words of the phrase stand consecutively. All exact places are reported; of other
places of a notice, those that overlap one with fewer edits, or an earlier one with as many, are not. Phrases are a
parameter, at most MOST_CHARS characters together, and go to the tasks with their code. Nothing is shuffled.

Null and empty texts have no words and no places; very long texts are scanned whole. Rows stand alone: ties don't arise, repeated rows
give equal results, an empty table gives an empty one. Columns to keep that are named like a result (n_words, notices) are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import groupby

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, fresh, lean
from .words import words_of

MOST_CHARS = 100_000
#: Windows whose result a worker remembers before it starts anew.
REMEMBERED = 50_000
#: Rows that are worked on at a time.
ROWS = 512


@dataclass(frozen=True)
class Notice:
    """A phrase of a licence; ``fixed`` words may not be misspelt, ``edits`` is the bound for all others together."""

    label: str
    phrase: str
    edits: int = 0
    fixed: tuple[str, ...] = ()
    base: bool = False


#: The three phrases that are looked up word by word, and further ones.
NOTICES = (
    Notice("mit", "under the mit license", 2, ("mit",), base=True),
    Notice("apache-2", "apache license version 2", 2, ("2",), base=True),
    Notice("cc-by-nc", "cc by nc", base=True),
    Notice("agpl", "gnu affero general public license", 3, ("affero",)),
    Notice("all-rights-reserved", "all rights reserved", 1),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("cc-by-sa", "cc by sa"),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("gpl-2", "gnu general public license version 2", 3, ("gnu", "2")),
    Notice("gpl-3", "gnu general public license version 3", 3, ("gnu", "3")),
    Notice("lgpl", "gnu lesser general public license", 3, ("lesser",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("mpl-2", "mozilla public license version 2", 3, ("2",)),
)


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """Where edits + 1 pieces of the padded phrase begin, and the pieces, as equal in length as can be."""
    whole = f" {phrase} "
    cuts = [k * len(whole) // (edits + 1) for k in range(edits + 2)]
    return [(a, whole[a:b]) for a, b in zip(cuts, cuts[1:])]


def matcher(notice: Notice) -> regex.Pattern:
    """The padded phrase, with errors allowed in all but its fixed words and the spaces around these."""
    parts, loose = [], [(fixed, " ".join(words)) for fixed, words in groupby(notice.phrase.split(" "), lambda w: w in notice.fixed)]
    for k, (fixed, words) in enumerate(loose):
        if fixed:
            parts.append(f" {regex.escape(words)} ")
        else:
            text = " " * (k == 0) + words + " " * (k == len(loose) - 1)
            parts.append(f"(?:{regex.escape(text)}){{e<={notice.edits}}}" if notice.edits else regex.escape(text))
    return regex.compile("(?b)" + "".join(parts))


class Scanner:
    """Finds the places of all notices in one text after another."""

    def __init__(self, notices: Iterable[Notice]):
        self.notices = list(notices)
        if sum(len(n.phrase) for n in self.notices) > MOST_CHARS:
            raise ValueError(f"phrases of more than {MOST_CHARS} characters")
        self.width = [len(n.phrase) + 2 for n in self.notices]
        self.find: list[Callable] = [matcher(n).search for n in self.notices]
        self.seen: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(self.notices):
            for at, piece in pieces(n.phrase, n.edits):
                seeds.setdefault(piece, []).append((k, at + len(piece) - 1))
        self.seeds = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.seeds.add_word(piece, of)
        self.seeds.make_automaton()

    def _best(self, k: int, window: str) -> tuple[int, int, int] | None:
        """Edits, begin and end of the best place of notice k in a window."""
        key = (k, window)
        if key not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            m = self.find[k](window)
            self.seen[key] = (sum(m.fuzzy_counts), *m.span()) if m and sum(m.fuzzy_counts) <= self.notices[k].edits else None
        return self.seen[key]

    def places(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """notice, first word, word behind the last one, edits; by notice and place."""
        text = f" {b' '.join(words).decode()} "
        found: dict[int, set[tuple[int, int, int]]] = {}
        for last, of in self.seeds.iter(text):
            for k, offset in of:
                margin, begin = self.notices[k].edits, last - offset
                low = max(0, begin - margin)
                best = self._best(k, text[low : begin + self.width[k] + margin])
                if best:
                    found.setdefault(k, set()).add((best[0], best[1] + low, best[2] + low))
        out = []
        for k, places in sorted(found.items()):
            taken: list[tuple[int, int]] = []
            kept = []
            for edits, begin, end in sorted(places):
                inner = (begin + (text[begin] == " "), end - (text[end - 1] == " "))
                if edits == 0 or not _meets(taken, inner):
                    kept.append((*inner, edits))
                    insort(taken, inner)
            word, at = 0, 1
            for begin, end, edits in sorted(kept):
                word += text.count(" ", at, begin)
                at = begin
                out.append((k, word, word + text.count(" ", begin, end) + 1, edits))
        return out


def _meets(taken: list[tuple[int, int]], span: tuple[int, int]) -> bool:
    """Whether ``span`` overlaps one of ``taken``, which are sorted and don't overlap unless exact."""
    at = bisect_left(taken, span)
    return any(a < span[1] and span[0] < b for a, b in taken[max(0, at - 2) : at + 1])


_RESULTS = ["n_words", "notices"]
_FOUND = "n_words long, notices array<struct<label: string, base: boolean, begin: int, end: int, edits: int, likeness: double>>"


def scan(docs: DataFrame, notices: Iterable[Notice] = NOTICES, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs`` its columns ``keep`` (doc_id by default), n_words long and notices, an array of: label, base (an exact place of a
    base notice), begin and end (in words, from 0, end excluded), edits, and likeness, 1 less the edits for each character of the phrase."""
    notices = tuple(notices)
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in _RESULTS]
    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL(_FOUND).fields])
    one = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("begin", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("likeness", pa.float64())])

    def run(batches: Batches) -> Batches:
        scanner = Scanner(notices)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                counts, found = [], []
                for words in words_of(batch.column(len(keep))):
                    counts.append(len(words))
                    places = ((notices[k], begin, end, edits) for k, begin, end, edits in scanner.places(words)) if words else ()
                    found.append([{"label": n.label, "base": n.base and not e, "begin": b, "end": z, "edits": e, "likeness": 1 - e / len(n.phrase)} for n, b, z, e in places])
                columns = [*batch.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(found, pa.list_(one))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(fresh(keep, "__text"))).mapInArrow(lean(run), schema)


def labels(notices: Column) -> Column:
    """The distinct labels of places, ascending, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(notices["label"])), ",")
