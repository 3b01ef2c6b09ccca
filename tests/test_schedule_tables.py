import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from domscope.streaming import schedule


def test_windows_and_next_runs_equal_the_functions(spark):
    random.seed(1)
    rows = []
    for k in range(400):
        today = date(2024, 2, 20) + timedelta(random.randint(0, 30))
        last = None if k % 5 == 0 else today - timedelta(random.randint(-2, 45))
        rows.append((k, random.choice([*schedule.SPAN, "yearly", None]), today, last, datetime(today.year, today.month, today.day, random.choice([8, 9, 23]), random.choice([0, 30]))))
    df = spark.createDataFrame(rows, "id int, frequency string, today date, last date, now timestamp")
    for delay, catch_up in ((1, False), (0, True), (3, False)):
        got = {r.id: r for r in schedule.next_runs(schedule.windows(df, delay=delay, catch_up=catch_up)).collect()}
        for k, frequency, today, last, now in rows:
            want = schedule.window(frequency, today, last, delay, catch_up)
            assert (got[k].first_day, got[k].last_day) == (want or (None, None)), rows[k]
            assert got[k].next_run == schedule.next_run(frequency, now)


def test_a_year_of_late_and_missing_days(spark):
    """Weekly runs of five subscriptions: what each reads, against a ledger in plain Python."""
    random.seed(2)
    first = date(2024, 1, 1)
    arrives = {first + timedelta(n): first + timedelta(n + random.choice([1, 1, 1, 3, 9, 40, 10_000])) for n in range(366)}
    since = {s: first + timedelta(20 * s - 10) for s in range(5)}
    subs = spark.createDataFrame(list(since.items()), "subscription_id int, since date")
    ledger, done, order = set(), spark.createDataFrame([], "subscription_id int, day date"), []
    for week in range(0, 366, 28):
        today = first + timedelta(week)
        there = [d for d, a in arrives.items() if a <= today]
        missing = schedule.unread(subs, done, F.lit(today - timedelta(1)))
        new = {(r.subscription_id, r.day) for r in schedule.to_read(missing, spark.createDataFrame([(d,) for d in there], "day date")).collect()}
        want = {(s, d) for s in since for d in there if since[s] <= d < today} - ledger
        assert new == want
        open_days = sum((r.last_day - r.first_day).days + 1 for r in missing.collect())
        assert open_days == sum(max(0, (today - a).days) for a in since.values()) - len(ledger)
        ledger |= new
        order.append(len(new))
        done = spark.createDataFrame(sorted(ledger), "subscription_id int, day date") if ledger else done
    assert ledger and sum(order) == len(ledger)


def test_intervals(spark):
    day = lambda n: date(2024, 3, n)
    df = spark.createDataFrame([(1, day(1)), (1, day(2)), (1, day(2)), (1, day(4)), (None, day(9)), (2, None)], "subscription_id int, day date")
    assert sorted((r.subscription_id or 0, r.first_day, r.last_day) for r in schedule.intervals(df).collect()) == [(0, day(9), day(9)), (1, day(1), day(2)), (1, day(4), day(4))]
