import random
from collections import Counter

import pytest

from domscope.functions.names import MOST_EDITS, edits_of_length
from domscope.operators import edit_index

ROW = "name string, key string"


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def words(seed, n, low, high, letters="abcdefghijklmnopqrstuvwxyz"):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(n)})


@pytest.mark.parametrize("itself", [True, False])
@pytest.mark.parametrize("few", [0, 10**9])
def test_near_some_equals_all_pairs(spark, monkeypatch, itself, few):
    monkeypatch.setattr(edit_index, "FEW", few)
    own, known = ["", "a", *words(1, 150, 0, 16, "abcü"), *words(2, 150, 6, 18)], ["", "abc", "ab", *words(3, 30, 0, 16, "abcü"), *words(2, 9, 6, 18)]
    bound = lambda t: max(2, min(6, len(t) // 2))
    want = {a for a in own if any(distance(a, t) <= bound(t) for t in known if itself or t != a)}
    frame = lambda x: spark.createDataFrame([(n, n) for n in [*x, x[0]]], ROW)
    got = [r.name for r in edit_index.near_some(frame(own), frame(known), edits_of_length, MOST_EDITS, itself).collect()]
    assert sorted(got) == sorted(want)
    assert edit_index.near_some(frame(own), frame(known).limit(0), edits_of_length, MOST_EDITS, itself).count() == 0


def test_few_keys_meet(spark):
    """Of 100000 names that end alike: what is verified for 300 of them, against all pairs of lengths in reach."""
    names = [f"{w}com" for w in words(5, 100_000, 14, 24)]
    own = random.Random(1).sample(names, 300)
    lengths = Counter(map(len, names))
    in_reach = sum(lengths[n] for x in own for n in range(len(x) - MOST_EDITS, len(x) + MOST_EDITS + 1))
    frame = lambda x: spark.createDataFrame([(n, n) for n in x], ROW)
    verified = []
    for edits in (*edit_index.FIRST, MOST_EDITS):
        a, b, on = edit_index.meeting(frame(own), frame(names), edits_of_length, edits, itself=False)
        verified.append(a.join(b, on).count())
    assert verified[0] < in_reach / 100_000 and verified[1] < in_reach / 5000 and verified[2] < in_reach / 20
