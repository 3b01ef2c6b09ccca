"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton is built over the words of all items. The words of a document are streamed through it;
at each word it gives the longest run of words, ending there, that some item has. Where that length
reaches the window, the words of the window are hit; where it reaches the length of an item shorter
than the window, the words of that item are. Two words that stand side by side in no item end every
run, so only stretches without such a pair, long enough for a window, go through the automaton.

Items without words, and items without an id, play no part; items that share an id count as one. Ids may be of any type;
they are carried, compared and sorted as strings. Null and empty texts have no words and no hits; very long texts are
streamed whole. Repeated documents are hit alike, each row on its own; an empty table of either kind gives no hits.
Columns to keep that are named like a result (n_words, spans, items) are left out.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, lean, written
from .words import words_of

#: Words of items in one automaton, which is some 20 MB when packed; more items are done in turns.
MOST_WORDS = 200_000
ROWS = 512
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BITS = 22


class SuffixAutomaton:
    """A suffix automaton of several sequences of integers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state of its own for the runs of at most length[p] + 1 that q stands for."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                q = self.next[last][c]
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def packed(self) -> Packed:
        """The same in arrays."""
        return Packed(self)


class Packed:
    """A suffix automaton to be walked, not to be added to. Most states have one successor, which two arrays hold;
    the others' are in one dictionary."""

    def __init__(self, sam: SuffixAutomaton):
        self.link, self.length = array("i", sam.link), array("i", sam.length)
        self.word, self.to = array("i", [-1]) * len(sam.next), array("i", [0]) * len(sam.next)
        self.more: dict[int, int] = {}
        for v, following in enumerate(sam.next):
            for k, (c, w) in enumerate(following.items()):
                if k:
                    self.more[v << 32 | c] = w
                else:
                    self.word[v], self.to[v] = c, w

    def step(self, state: int, c: int) -> int:
        """The state behind ``state`` by the word ``c``; -1 if there is none."""
        return self.to[state] if self.word[state] == c else self.more.get(state << 32 | c, -1)

    def walk(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """At each place the state and length of the longest run, ending there, that some sequence has."""
        state = length = 0
        for c in sequence:
            to = self.step(state, c) if c >= 0 else -1
            while to < 0 and state:
                state = self.link[state] if c >= 0 else 0
                length = self.length[state]
                to = self.step(state, c) if c >= 0 else -1
            if to >= 0:
                state = to
                length += 1
            yield state, length


class Items:
    """The automaton of test items, and which items its states belong to."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items if words]
        self.shortest = min((min(len(s), window) for _, s in coded), default=window)
        building = SuffixAutomaton()
        for _, s in coded:
            building.add(s)
        self.sam = sam = building.packed()
        del building
        n = len(sam.link)
        self.of: dict[int, set[str]] = {}  # for the states whose shortest runs are no longer than a window, and whose longest are no shorter: the items that have them
        self.short: dict[int, list[tuple[int, str]]] = {}  # length and id of shorter items
        pairs = set()
        for item, s in coded:
            pairs.update(zip(s, s[1:]))
            state = 0
            for c in s:
                state = sam.step(state, c)
                v = state
                while sam.length[v] >= window:
                    if sam.length[sam.link[v]] < window:
                        self.of.setdefault(v, set()).add(item)
                        break
                    v = sam.link[v]
            if len(s) < window:
                self.short.setdefault(state, []).append((len(s), item))
        near = array("i", [-1]) * n  # the nearest state among a state and those it links to that has short items
        for v in sorted(range(n), key=sam.length.__getitem__):
            near[v] = v if v in self.short else near[sam.link[v]] if v else -1
        self.near = near
        self.paired = np.zeros(1 << _BITS, bool)
        if pairs:
            a, b = np.array(sorted(pairs), np.int64).T
            self.paired[self._slot(a, b)] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - _BITS)).astype(np.int64)

    def stretches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where stretches begin and end that may hold a window. Words that no item has are -1."""
        known = ids >= 0
        if self.shortest > 1:
            linked = known[:-1] & known[1:]
            at = np.flatnonzero(linked)
            linked[at] = self.paired[self._slot(ids[at], ids[at + 1])]
            least = self.shortest - 1
        else:
            linked, least = known, 1
        edges = np.diff(np.concatenate([[0], linked.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        fit = end - begin >= least
        return begin[fit], end[fit] + (self.shortest > 1)

    def hits(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Places, from and to, that windows take up, merged, and the items that have these windows."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        link, length_of = self.sam.link, self.sam.length
        for at, (state, length) in enumerate(self.sam.walk(ids)):
            width = 0
            if length >= self.window:
                v = state
                while length_of[link[v]] >= self.window:
                    v = link[v]
                items |= self.of[v]
                width = self.window
            v = self.near[state]
            while v > 0:
                for n, item in self.short[v]:
                    if n <= length:
                        items.add(item)
                        width = max(width, n)
                v = self.near[link[v]]
            if width:
                begin = at + 1 - width
                while spans and begin <= spans[-1][1]:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at + 1))
        return spans, items


def read_items(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words, in lots of at most MOST_WORDS words, or of one item."""
    lot, size = [], 0
    rows = items.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    for item, text in rows.distinct().orderBy("item", "text").toLocalIterator():
        words = next(words_of(pa.array([text], pa.string())))
        if lot and size + len(words) > MOST_WORDS:
            yield lot
            lot, size = [], 0
        lot.append((item, words))
        size += len(words)
    yield lot


_RESULTS = ["n_words", "spans", "items"]
_HITS = "n_words long, spans array<struct<begin: int, end: int>>, items array<string>"


def find_hits(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs`` its columns ``keep`` (doc_id by default), n_words long, spans
    array<struct<begin, end>> (merged, in words, end excluded) and items array<string>, those whose
    windows occur, ascending. Other columns are left out, so no name clashes.

    Items of one automaton take one pass. With more, rows get numbers in a table of their own, each further automaton
    reads its texts once and yields only the rows that it hits, and these are put together by number.
    """
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in _RESULTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    lots = read_items(items, item_id, item_text)
    first, second = next(lots), next(lots, None)
    if second is None:
        return _one_turn(rows, first, window, keep)
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "decontaminate")
    base = _one_turn(rows, first, window, [*keep, "__row"])
    hits = base.where("size(items) > 0").select("__row", "spans", "items")
    while second is not None:
        turn = _one_turn(rows, second, window, ["__row"]).where("size(items) > 0").select("__row", "spans", "items")
        hits, second = hits.unionByName(written(turn, "hits")), next(lots, None)
    joined = hits.groupBy("__row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    merged = F.aggregate(
        "s",
        F.expr("cast(array() as array<struct<begin: int, end: int>>)"),
        lambda t, x: F.when((F.size(t) > 0) & (F.try_element_at(t, F.lit(-1))["end"] >= x["begin"]), F.concat(F.slice(t, 1, F.size(t) - 1), F.array(F.struct(F.try_element_at(t, F.lit(-1))["begin"].alias("begin"), F.greatest(F.try_element_at(t, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(t, F.array(x))),
    )
    joined = written(joined.select("__row", merged.alias("s"), "i"), "hits")
    return base.join(joined, "__row", "left").select(*[F.col(f"`{c}`") for c in keep], "n_words", F.coalesce("s", "spans").alias("spans"), F.coalesce("i", "items").alias("items"))


def _one_turn(docs: DataFrame, lot: list[tuple[str, list[bytes]]], window: int, keep: list[str]) -> DataFrame:
    """``keep`` and the results, of docs with a column __text."""
    shared = docs.sparkSession.sparkContext.broadcast(Items(lot, window))  # of at most MOST_WORDS words
    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL(_HITS).fields])
    names = schema.names
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Batches) -> Batches:
        found = shared.value
        get = found.vocab.get
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids, ends = [], []
                total = 0
                for words in words_of(batch.column(len(keep))):
                    ids.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
                    ids.append(np.array([-1], np.int32))
                    total += len(words) + 1
                    ends.append(total)
                flat, ends = np.concatenate(ids), np.array(ends)
                starts = np.concatenate([[0], ends[:-1]])
                begin, end = found.stretches(flat)
                owner = np.searchsorted(ends, begin, "right")
                fresh: dict[int, tuple[list, set]] = {}
                for b, e, doc in zip(begin.tolist(), end.tolist(), owner.tolist()):
                    s, i = found.hits(flat[b:e].tolist())
                    if s:
                        mine = fresh.setdefault(doc, ([], set()))
                        mine[0].extend((x + b - int(starts[doc]), y + b - int(starts[doc])) for x, y in s)
                        mine[1].update(i)
                spans, items = [[] for _ in ends], [[] for _ in ends]
                for doc, (s, i) in fresh.items():
                    merged: list[list[int]] = []
                    for x, y in sorted(s):
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], y)
                        else:
                            merged.append([x, y])
                    spans[doc], items[doc] = [{"begin": x, "end": y} for x, y in merged], sorted(i)
                columns = [*batch.columns[: len(keep)], pa.array(ends - starts - 1, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], "__text").mapInArrow(lean(run), schema)


def _cut(text: str, spans: list) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["begin"]][0]])
        at = places[s["end"] - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most_hit: float = 0.8, text_col: str = "text") -> DataFrame:
    """``docs`` without benchmark passages: each span of hit words is cut out of its text, and documents
    of which more than the share ``most_hit`` of the words is hit are left out. All columns stay; a
    column n_chars is counted anew where the text changed.
    """
    tag = "__row"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(tag), F.col(f"`{text_col}`").alias("__own"))
    found = find_hits(rows, items, window, "__own", [tag])
    names = docs.columns
    fields = docs.schema.fields
    where = names.index(text_col)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            own = batch.column(0)
            texts, spans = own.field(where), batch.column(1)
            hit = np.flatnonzero(spans.value_lengths().to_numpy(zero_copy_only=False) > 0).tolist()
            columns = [own.field(k) for k in range(len(names))]
            if hit:
                new = texts.to_pylist()
                for k in hit:
                    new[k] = _cut(new[k], spans[k].as_py())
                columns[where] = pa.array(new, pa.string())
                if "n_chars" in names and columns[names.index("n_chars")].type == pa.int64():
                    counts = columns[names.index("n_chars")].to_pylist()
                    for k in hit:
                        counts[k] = len(new[k])
                    columns[names.index("n_chars")] = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"])
    kept = found.where(n_hit <= F.lit(most_hit) * F.col("n_words")).select(tag, "spans")
    return kept.mapInArrow(lean(run), T.StructType(fields))
