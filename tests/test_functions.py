from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from domscope.functions import cleaning, labels, lexical, names
from domscope.streaming import schedule


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_grams_and_patterns(spark):
    g = lambda x: names.char_grams(F.lit(x))
    p = lambda x: names.pattern_score(F.split(F.lit(x), " "))
    r = one(spark, a=g("ab"), b=g("abc"), c=g("abcd"), d=g(""), e=p("mail login verify"), f=p("mail login update"), g=p("login verify"), h=p("login"), i=names.jaccard(g("abcd"), g("")))
    assert (r.a, r.b, r.c, r.d) == (["ab"], ["abc"], ["abc", "bcd"], [])
    assert (r.e, r.f, r.g, r.h, r.i) == (0.9, 0.85, 0.6, 0.0, 0.0)


@given(st.lists(st.sampled_from("abcd"), max_size=6), st.lists(st.sampled_from("abcd"), max_size=6))
@settings(max_examples=15, deadline=None)
def test_jaccard_is_symmetric(spark, a, b):
    x, y = (F.lit(v).cast("array<string>") if v else F.array().cast("array<string>") for v in (a, b))
    r = one(spark, p=names.jaccard(x, y), q=names.jaccard(y, x))
    assert r.p == r.q == (len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0)


def test_domains(spark):
    d = names.normal_domain(F.lit(" HTTPS://Mail.Example.com:8080/a?b#c "))
    r = one(spark, d=d, s=names.sld(d), t=names.tld(d), k=names.key_domain(d), w=names.domain_tokens(F.lit("a-1b_c.com")), one=names.sld(F.lit("host")), none=names.tld(F.lit("host")), kw=names.domain_keywords(F.array(F.lit("login-ab.mail7x.example.com"), F.lit("www.zeta.org"))))
    assert (r.d, r.s, r.t, r.k, r.w, r.one, r.none) == ("mail.example.com", "example", "com", "mailexamplecom", ["a", "b", "c", "com"], "host", "")
    assert r.kw == ["example", "login", "mail", "zeta"]
    bounds = [one(spark, k=names.edit_bound(F.lit("x" * n)), s=names.similarity_bound(F.lit("x" * n))) for n in (3, 4, 6, 7, 9, 20)]
    assert [b.k for b in bounds] == [2, 2, 3, 3, 4, 6] and [b.s for b in bounds] == [0.92, 0.92, 0.88, 0.85, 0.85, 0.85]


@pytest.mark.parametrize("a,b", [("kitten", "sitting"), ("", "ab"), ("abc", "abc"), ("abcdefgh", "a")])
def test_bounded_distance(spark, a, b):
    r = one(spark, d=F.levenshtein(F.lit(a), F.lit(b)), k2=names.within_edits(F.lit(a), F.lit(b), F.lit(2)), k3=names.within_edits(F.lit(a), F.lit(b), F.lit(3)))
    assert (r.k2, r.k3) == (r.d <= 2, r.d <= 3)


def test_bands(spark):
    r = one(spark, a=F.array(*[labels.confidence(F.lit(x)) for x in (0.8, 0.5, 0.0001, 0.0)]), b=F.array(*[labels.risk_level(F.lit(x).cast("double")) for x in (None, 0.8, 0.5, 0.0)]))
    assert r.a == ["high", "medium", "low", "none"] and r.b == ["unknown", "high", "medium", "low"]


def test_cleaning(spark):
    lists = [cleaning.any_list(F.lit(x).cast("string")) for x in ('["a", " b "]', "a, b;c|d", "", None, "null", '"x"', "7", "[broken")]
    dates = [cleaning.mixed_date(F.lit(x)) for x in ("2024-01-05", "2024/1/5", "45292", "45292.5", "junk", "2024-13-45")]
    r = one(spark, lists=F.array(*lists), dates=F.array(*dates), pipes=cleaning.pipe_list(F.lit("A | B|C | D")), none=cleaning.pipe_list(F.lit("  ")), n=F.array(*[cleaning.to_int(F.lit(x)) for x in ("12x", " 7 ", "", "x")]))
    assert r.lists == [["a", "b"], ["a", "b", "c", "d"], [], [], [], ["x"], ["7"], ["[broken"]]
    assert r.dates == [date(2024, 1, 5), date(2024, 1, 5), date(2024, 1, 1), date(2024, 1, 1), None, None]
    assert (r.pipes, r.none, r.n) == (["A", "B|C", "D"], [], [12, 7, None, None])
    r = one(spark, a=cleaning.certificate_time(F.lit("Jan  5 12:30:00 2024 GMT")), b=F.array(*[cleaning.any_date(F.lit(x)) for x in ("2024-01-05", "2024/1/5", "2024-01-05 10:00:00", "05-Jan-2024", "2024-01-05T10:00:00Z", "?")]), c=cleaning.percent_text(F.lit(1), F.lit(3)), d=cleaning.percent_text(F.lit(1), F.lit(0)))
    assert r.a == datetime(2024, 1, 5, 12, 30) and r.b == [date(2024, 1, 5)] * 5 + [None] and (r.c, r.d) == ("33.33%", "0.00%")


def test_features(spark):
    import math
    from collections import Counter

    d = spark.createDataFrame([("google.com",), ("11a21.sub12.example456.com",), ("host",), ("www-army-mil-bd.dirctt88.co",), ("2024",)], "d string")
    rows = {r.d: r for r in d.select("d", *lexical.features(F.col("d"))).collect()}
    g = rows["google.com"]
    assert [g[n] for n in lexical.NAMES[:9]] == [6, 3, 0, 0, 1, 0, 0, 0, 1]
    for name, r in rows.items():
        n = len(name)
        assert abs(r.entropy + sum(k / n * math.log2(k / n) for k in Counter(name).values())) < 1e-9
    assert (rows["11a21.sub12.example456.com"].digits, rows["11a21.sub12.example456.com"].rest_digits) == (9, 6)
    assert (rows["host"].sld_length, rows["2024"].digits, rows["www-army-mil-bd.dirctt88.co"].has_www) == (0, 1, 1)
    assert rows["www-army-mil-bd.dirctt88.co"].hyphens == 3 and len(lexical.NAMES) == 25


@pytest.mark.parametrize(
    "frequency,today,last,expected",
    [
        ("daily", date(2024, 1, 9), None, ("2024-01-08", "2024-01-08")),
        ("daily", date(2024, 1, 9), date(2024, 1, 7), ("2024-01-08", "2024-01-08")),
        ("daily", date(2024, 1, 9), date(2024, 1, 3), ("2024-01-08", "2024-01-08")),
        ("daily", date(2024, 1, 9), date(2024, 1, 8), None),
        ("weekly", date(2024, 1, 15), None, ("2024-01-08", "2024-01-14")),
        ("weekly", date(2024, 1, 22), date(2024, 1, 14), ("2024-01-15", "2024-01-21")),
        ("monthly", date(2024, 3, 1), date(2023, 1, 1), ("2024-01-31", "2024-02-29")),
    ],
)
def test_windows(frequency, today, last, expected):
    got = schedule.window(frequency, today, last)
    assert got == (expected and tuple(map(date.fromisoformat, expected)))


@given(st.sampled_from(["daily", "weekly", "monthly"]), st.dates(date(2020, 1, 1), date(2030, 1, 1)), st.dates(date(2019, 1, 1), date(2030, 1, 1)), st.booleans())
def test_windows_are_in_order(frequency, today, last, catch_up):
    w = schedule.window(frequency, today, last, catch_up=catch_up)
    assert w is None or last < w[0] <= w[1] < today


def test_next_run():
    assert schedule.next_run("daily", datetime(2024, 1, 9, 8, 59)) == datetime(2024, 1, 9, 9)
    assert schedule.next_run("daily", datetime(2024, 1, 9, 9)) == datetime(2024, 1, 10, 9)
    assert schedule.next_run("weekly", datetime(2024, 1, 9, 8)) == datetime(2024, 1, 16, 9)
