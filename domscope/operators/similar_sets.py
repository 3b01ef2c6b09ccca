"""The most similar set by Jaccard, exactly, without joining on elements that most sets have.

Elements are ordered by how many of the known sets have them, the rarest first. Sets whose similarity reaches a floor share one
of their first elements (a prefix, the shorter the higher the floor), have sizes that are close, and the places where they first meet
leave room for enough more. So rounds with falling floors each join prefixes only, and a set whose best so far reaches the floor
is done: nothing that is found later can be better. What is left meets the known sets in two ways that are exact
together: by elements that at most MOST known sets have, and, where only commoner elements are shared,
by classes. The similarity of two sets that share common elements alone depends on these and on the sizes, so sets
that agree in both are one class, of which the first is enough.

Sets are arrays without repeated elements; empty ones and nulls meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Tenths of similarity: of these floors only the prefixes meet.
FLOORS = (6, 3)
#: Known sets that may have an element by which sets are joined one by one.
MOST = 200


def ordered(sets: DataFrame, known: DataFrame, most: int = MOST) -> DataFrame:
    """``sets`` with grams in order of how many of ``known`` have them, the rarest first, and ``common``, those
    that more than ``most`` have. The other columns have to tell rows apart."""
    keys = [c for c in sets.columns if c != "grams"]
    n = known.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    each = sets.select(*keys, F.explode("grams").alias("g")).join(n, "g", "left")
    met = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("by"))
    return met.select(*keys, F.col("by.g").alias("grams"), F.filter("by", lambda x: x["n"] > most)["g"].alias("common"))


def _jaccard(shared: Column, a: Column, b: Column) -> Column:
    return shared / (a + b - shared)


def prefix_pairs(own: DataFrame, known: DataFrame, floor: int, itself: bool = True) -> DataFrame:
    """own, name, place, score of pairs that share an element of their prefixes and pass the bounds of size and place for a
    similarity of ``floor`` tenths. ``own``: own, grams; ``known``: name, place, grams; both by ordered()."""
    size = F.size("grams")
    least = lambda n: F.call_function("div", F.lit(floor) * n + 9, F.lit(10)).cast("int")
    prefix = F.posexplode(F.slice("grams", F.lit(1), size - least(size) + 1))
    a = own.select("own", F.col("grams").alias("x"), size.alias("nx"), prefix.alias("px", "g"))
    b = known.select("name", "place", F.col("grams").alias("y"), size.alias("ny"), prefix.alias("py", "g"))
    fits = "g = h AND ny * 10 >= nx * {0} AND nx * 10 >= ny * {0} AND (10 + {0}) * least(nx - px, ny - py) >= {0} * (nx + ny)".format(floor)
    met = a.join(b.withColumnRenamed("g", "h"), F.expr(fits if itself else f"{fits} AND own <> name"))
    both = met.withColumn("both", F.array_intersect("x", "y"))
    # A pair that meets by several elements counts where it meets first.
    first = both.where(F.col("both")[0] == F.col("g"))
    return first.select("own", "name", "place", _jaccard(F.size("both"), F.col("nx"), F.col("ny")).alias("score"))


def rare_pairs(own: DataFrame, known: DataFrame, by: list[str], itself: bool = True) -> DataFrame:
    """own, *by, name, place, score of pairs that share an element which isn't common. ``own``: own, grams, common; ``known``: *by, name, place,
    grams, common."""
    rare = lambda c: F.explode(F.array_except("grams", "common")).alias(c)
    a = own.select("own", F.col("grams").alias("x"), F.size("grams").alias("nx"), rare("g"))
    b = known.select(*by, "name", "place", F.col("grams").alias("y"), F.size("grams").alias("ny"), rare("h"))
    met = a.join(b, F.expr("g = h" if itself else "g = h AND own <> name")).withColumn("both", F.array_intersect("x", "y"))
    first = met.where(F.col("both")[0] == F.col("g"))
    return first.select("own", *by, "name", "place", _jaccard(F.size("both"), F.col("nx"), F.col("ny")).alias("score"))


def _best(pairs: DataFrame, *by: str) -> DataFrame:
    """Of each ``by`` the pair with the highest score, of equals the first place."""
    return pairs.groupBy(*by).agg(F.min(_rank()).alias("b")).select(*by, "b.name", "b.place", (-F.col("b.s")).alias("score"))


def _rank() -> Column:
    return F.struct((-F.col("score")).alias("s"), "place", "name")


def _second(pairs: DataFrame, best: DataFrame, *by: str) -> DataFrame:
    """What _best() would give without the pairs that it gives."""
    first = best.select(*[F.col(c).alias(f"b_{c}") for c in by], _rank().alias("first"))
    same = [F.col(c) == F.col(f"b_{c}") for c in by]
    return _best(pairs.join(first, same).where(_rank() > F.col("first")), *by)


def class_best(own: DataFrame, known: DataFrame, by: list[str], itself: bool = True) -> DataFrame:
    """nx, common, *by, name, place, score: for own sets of nx elements with these common ones the best known set (of each group ``by``) by
    common elements alone; the two best unless ``itself``. The score is the similarity where no other element is shared, and less than
    that elsewhere. Known sets with the same common elements and size are one class, which its first one or two stand for."""
    a = own.where(F.size("common") > 0).select(F.size("grams").alias("nx"), "common").distinct()
    b = known.where(F.size("common") > 0).select(*by, "name", "place", F.size("grams").alias("ny"), F.col("common").alias("theirs"), F.lit(0.0).alias("score"))
    first = _best(b, *by, "ny", "theirs")
    classes = first if itself else first.unionByName(_second(b, first, *by, "ny", "theirs"))
    met = a.withColumn("g", F.explode("common")).join(classes.drop("score").withColumn("h", F.explode("theirs")), F.expr("g = h")).withColumn("both", F.array_intersect("common", "theirs"))
    pairs = met.where(F.col("both")[0] == F.col("g")).select("nx", "common", *by, "name", "place", _jaccard(F.size("both"), F.col("nx"), F.col("ny")).alias("score"))
    best = _best(pairs, "nx", "common", *by)
    return best if itself else best.unionByName(_second(pairs, best, "nx", "common", *by))


def by_class(own: DataFrame, classes: DataFrame) -> DataFrame:
    """``own``, each row with the rows of class_best() of its class."""
    return own.withColumn("nx", F.size("grams")).join(classes, ["nx", "common"]).drop("nx")


def most_similar(own: DataFrame, known: DataFrame, itself: bool = True, most: int = MOST) -> DataFrame:
    """own, name, place, score: of each set that shares an element with a known one the most similar of these, of equals that with the
    first place. ``own``: own, grams; ``known``: name, place, grams. A known set of the same name is left out unless ``itself``."""
    known = stored(ordered(known, known, most), "known-sets")
    rest, done = stored(ordered(own, known, most), "own-sets"), []
    for floor in FLOORS:
        done.append(stored(_best(prefix_pairs(rest, known, floor, itself).where(F.col("score") * 10 >= floor), "own"), "found"))
        rest = rest.join(done[-1].select("own"), "own", "left_anti")
    classes = by_class(rest, class_best(rest, known, [], itself)).select("own", "name", "place", "score")
    out = _best(rare_pairs(rest, known, [], itself).unionByName(classes if itself else classes.where("own <> name")), "own")
    for found in done:
        out = out.unionByName(found)
    return out


def most_similar_of_each(own: DataFrame, known: DataFrame, by: str, most: int = MOST) -> DataFrame:
    """own, *by, name, place, score: as most_similar(), for each group ``by`` of known sets of which one shares an element."""
    theirs, mine = ordered(known, known, most), ordered(own, known, most)
    classes = by_class(mine, class_best(mine, theirs, [by])).select("own", by, "name", "place", "score")
    return _best(rare_pairs(mine, theirs, [by]).unionByName(classes), "own", by)
