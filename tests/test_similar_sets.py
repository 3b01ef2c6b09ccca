import random

import pytest
from pyspark.sql import functions as F

from domscope.functions.names import char_grams
from domscope.operators import similar_sets


def made(n, seed):
    """Names most of which end in .com, so that some trigrams are in nearly all of them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 7)))
    names = {f"{word()}{r.choice(['', '-', '.'])}{word()}.{r.choice(['com', 'com', 'com', 'org', 'co'])}" for _ in range(n)}
    return sorted(names | {"q", "zz", "xy.qq", "com"})


def frames(spark, names):
    own = spark.createDataFrame([(x,) for x in names], "own string").select("own", char_grams(F.col("own")).alias("grams"))
    return own, own.select(F.col("own").alias("name"), F.col("own").alias("place"), "grams")


def grams(t):
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))}


@pytest.mark.parametrize("itself", [False, True])
@pytest.mark.parametrize("most", [4, 200])
def test_most_similar_equals_all_pairs(spark, itself, most):
    names = made(300, 1)
    sets = {n: grams(n) for n in names}
    want = {}
    for a in names:
        scored = [(-len(sets[a] & sets[b]) / len(sets[a] | sets[b]), b) for b in names if (itself or a != b) and sets[a] & sets[b]]
        if scored:
            want[a] = min(scored)
    own, known = frames(spark, names)
    assert {r.own: (-r.score, r.name) for r in similar_sets.most_similar(own, known, itself, most).collect()} == want


@pytest.mark.parametrize("most", [0, 6, 200])
def test_each_group_equals_all_pairs(spark, most):
    own, known = frames(spark, made(200, 2))
    known = known.withColumns({"org": F.pmod(F.xxhash64("name"), F.lit(4)), "place": F.xxhash64("name")})
    rows, mine = known.collect(), own.limit(50)
    want = {}
    for r in mine.collect():
        for k in rows:
            if shared := len(set(r.grams) & set(k.grams)):
                x = (-shared / (len(r.grams) + len(k.grams) - shared), k.place, k.name)
                want[r.own, k.org] = min(x, want.get((r.own, k.org), x))
    assert {(r.own, r.org): (-r.score, r.place, r.name) for r in similar_sets.most_similar_of_each(mine, known, "org", most).collect()} == want


def test_few_pairs_meet(spark):
    """Of 4000 names nearly all share a trigram with each other; the index looks at a small part of these pairs, and no
    common trigram is joined."""
    names = made(4000, 3)
    own, known = frames(spark, names)
    known = similar_sets.ordered(known, known).cache()
    own = similar_sets.ordered(own, known).cache()
    sharing = sum(n * n for (n,) in known.select(F.explode("grams").alias("g")).groupBy("g").count().select("count").collect())
    pairs = [similar_sets.prefix_pairs(own, known, f, itself=False).count() for f in similar_sets.FLOORS]
    assert sum(pairs) < sharing / 50 and pairs == sorted(pairs)
    common = {g for r in known.select("common").distinct().collect() for g in r.common}
    assert {".co", "com"} <= common and not common & {r.g for r in known.select(F.explode(F.array_except("grams", "common")).alias("g")).distinct().collect()}
    assert similar_sets.rare_pairs(own, known, [], itself=False).count() <= similar_sets.MOST * sum(len(grams(n)) for n in names)
    classes = similar_sets.class_best(own, known, [], itself=False)
    assert classes.count() <= 2 * own.select(F.size("grams"), "common").distinct().count()


def test_empty_sets(spark):
    own, known = frames(spark, ["abc.com"])
    none = own.where("FALSE")
    assert similar_sets.most_similar(none, known).count() == similar_sets.most_similar(own, known.where("FALSE")).count() == 0
    blank = own.select("own", F.array().cast("array<string>").alias("grams"))
    assert similar_sets.most_similar(blank, known).count() == 0
