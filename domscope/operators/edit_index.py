"""Strings within an edit distance of some other one, by segments.

Of a target's k + 2 pieces a string within k edits of it holds two unchanged, each near the place where the target has it. So a
target's commonest piece - the ending of a domain, as a rule - can be left out, and the others are listed by (length, number of
the piece, piece). A candidate looks up its substrings for each target length in reach, at the places that the numbers of
edits before and behind a piece allow. What meets is verified, with a comparison that ends once the bound is passed. Fewer edits need
fewer and longer pieces, which few strings share, so candidates are tried with few edits first and only those without a target
go on to more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Edits that are tried first; those that a target's length allows are the last. Where there are no more than so many pairs they are the only ones.
FIRST, FEW = (1, 3), 1_000_000


def _cut(i: str) -> str:
    """Where the piece of this number begins, from 0, if a length n is cut in edits + 2."""
    return f"CAST(({i}) * n DIV (edits + 2) AS INT)"


def pieces(known: DataFrame, bound: Callable[[Column], Column], most: int) -> DataFrame:
    """``known`` (name, key) with edits - those that bound(length of the key) allows, ``most`` at most - and a row for each piece but
    the commonest: n, i, piece."""
    x = known.withColumn("n", F.char_length("key")).withColumn("edits", F.least(bound(F.col("n")), F.lit(most)))
    cut = f"transform(sequence(0, edits + 1), i -> struct(i AS i, substring(key, {_cut('i')} + 1, {_cut('i + 1')} - {_cut('i')}) AS piece))"
    x = x.withColumn("p", F.explode(F.expr(cut))).select("name", "key", "edits", "n", "p.i", "p.piece")
    counted = x.join(x.groupBy("n", "i", "piece").agg(F.count(F.lit(1)).alias("k")), ["n", "i", "piece"])
    whole = counted.groupBy("name", "key", "edits", "n").agg(F.array_sort(F.collect_list(F.struct("k", "i", "piece"))).alias("p"))
    return whole.select("name", "key", "edits", "n", F.explode(F.slice("p", F.lit(1), F.col("edits") + 1)).alias("p")).select("name", "key", "edits", "n", "p.i", "p.piece")


def lookups(own: DataFrame, bound: Callable[[Column], Column], most: int) -> DataFrame:
    """``own`` (name, key) with a row for each piece that a target in reach may share with it: n, i, piece."""
    x = own.withColumn("s", F.char_length("key"))
    x = x.withColumn("n", F.explode(F.sequence(F.greatest(F.col("s") - most, F.lit(0)), F.col("s") + most)))
    x = x.withColumn("edits", F.least(bound(F.col("n")), F.lit(most))).where("abs(s - n) <= edits")
    x = x.withColumn("i", F.explode(F.expr("sequence(0, edits + 1)"))).withColumns({"at": F.expr(f"{_cut('i')} + 1"), "wide": F.expr(f"{_cut('i + 1')} - {_cut('i')}")})
    low, high = "greatest(1, at - CAST((edits - s + n) DIV 2 AS INT))", "least(s - wide + 1, at + CAST((edits + s - n) DIV 2 AS INT))"
    found = f"CASE WHEN {high} >= {low} THEN array_distinct(transform(sequence({low}, {high}), a -> substring(key, a, wide))) END"
    return x.select("name", "key", "n", "i", F.explode(F.expr(found)).alias("piece"))


def meeting(own: DataFrame, known: DataFrame, bound: Callable[[Column], Column], most: int, itself: bool = True) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of the join of lookups() and pieces(), and its condition but for the verification."""
    a, b = lookups(own, bound, most).alias("a"), pieces(known, bound, most).alias("b")
    on = F.expr("a.n = b.n AND a.i = b.i AND a.piece = b.piece" + ("" if itself else " AND a.name <> b.name"))
    return a, b, on


def near_some(own: DataFrame, known: DataFrame, bound: Callable[[Column], Column], most: int, itself: bool = True) -> DataFrame:
    """name, key of ``own`` whose key is within the edits that some key of ``known`` allows by its length: bound(length), never more
    than ``most``. ``own`` and ``known``: name, key; a known one of the same name doesn't count unless ``itself``."""
    known = stored((known.withColumn("name", F.lit(None).cast("string")) if itself else known).select("name", "key").distinct(), "known-keys")
    rest, out, targets = own.select("name", "key").distinct(), None, known.count()
    for edits in [*[x for x in FIRST if x < most], most]:
        if edits < most and rest.count() * targets <= FEW:
            continue
        a, b, on = meeting(rest, known, bound, edits, itself)
        within = on & (F.call_function("levenshtein", F.col("a.key"), F.col("b.key"), F.col("b.edits")) >= 0)
        found = stored(a.join(b, within, "left_semi").select("name", "key").distinct(), "near")
        out = found if out is None else out.unionByName(found)
        rest = rest.join(found, ["name", "key"], "left_anti")
    return out
