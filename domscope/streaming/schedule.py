"""When subscriptions run, and over which days. Pure functions of explicit times, and filters on tables."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.relational import first_by_key

# Days that a frequency covers, the hour of the run, the days that data arrive late.
SPAN = {"daily": 1, "weekly": 7, "monthly": 30}
RUN_AT = time(9, 0)
DELAY_DAYS = 1


def window(frequency: str, today: date, last: date | None = None, delay: int = DELAY_DAYS, catch_up: bool = False) -> tuple[date, date] | None:
    """The days to be read, both included, or None if there is nothing new.

    The last day is ``delay`` days ago. The first is the day after ``last``, but no earlier than the frequency's
    span allows - so a daily run reads one day and days missed are left out - unless ``catch_up``.
    """
    end = today - timedelta(delay)
    span = end - timedelta(SPAN.get(frequency, 7) - 1)
    if last is None:
        return span, end
    start = last + timedelta(1)
    if start > end:
        return None
    return (start if catch_up or frequency not in SPAN else max(start, span)), end


def next_run(frequency: str, now: datetime) -> datetime:
    """The next run at RUN_AT: the coming one for daily, a span later for the others."""
    run = datetime.combine(now.date(), RUN_AT)
    if run <= now:
        run += timedelta(1)
    return run + timedelta(0 if frequency == "daily" else SPAN.get(frequency, 1))


def windows(runs: DataFrame, frequency: str = "frequency", today: str = "today", last: str = "last", delay: int = DELAY_DAYS, catch_up: bool = False) -> DataFrame:
    """``runs`` with first_day and last_day: window() of each row, both null where there is nothing new."""
    end = F.date_sub(today, delay)
    known = F.col(frequency).isin(*SPAN)
    span = F.date_sub(end, _span(frequency, 7) - 1)
    start = F.date_add(last, 1)
    first = F.when(F.col(last).isNull(), span).when(start > end, None).when(F.lit(catch_up) | ~F.coalesce(known, F.lit(False)), start).otherwise(F.greatest(start, span))
    return runs.withColumns({"first_day": first, "last_day": F.when(first.isNotNull(), end)})


def next_runs(runs: DataFrame, frequency: str = "frequency", now: str = "now") -> DataFrame:
    """``runs`` with next_run: next_run() of each row."""
    run = F.date_trunc("day", now) + F.make_interval(hours=F.lit(RUN_AT.hour), mins=F.lit(RUN_AT.minute))
    wait = F.when(run <= F.col(now), 1).otherwise(0) + F.when(F.col(frequency) == "daily", 0).otherwise(_span(frequency, 1))
    return runs.withColumn("next_run", run + F.make_interval(days=wait))


def _span(frequency: str, other: int) -> Column:
    return F.coalesce(*[F.when(F.col(frequency) == f, n) for f, n in SPAN.items()], F.lit(other))


def intervals(days: DataFrame, key: str = "subscription_id", day: str = "day") -> DataFrame:
    """key, first_day, last_day: the days of each key as runs without gaps."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(day))
    runs = days.where(F.col(day).isNotNull()).select(key, day).distinct().withColumn("__run", F.date_sub(day, place))
    return runs.groupBy(key, "__run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")).drop("__run")


def unread(subscriptions: DataFrame, read: DataFrame, upto: Column, key: str = "subscription_id") -> DataFrame:
    """key, first_day, last_day: the runs of days from the subscription's ``since`` up to ``upto`` that weren't read; days that came late or
    were missed stay until they are. ``read``: key, day, of which those before since don't count."""
    own = subscriptions.select(key, "since", upto.alias("upto")).where("since <= upto")
    done = intervals(read.join(own, key, "left_semi"), key).join(own, key).where("last_day >= since AND first_day <= upto")
    order = Window.partitionBy(key).orderBy("first_day")
    gaps = done.select(key, F.date_add("last_day", 1).alias("a"), F.date_sub(F.coalesce(F.lead("first_day").over(order), F.date_add("upto", 1)), 1).alias("z"))
    head = own.join(done.groupBy(key).agg(F.min("first_day").alias("first")), key, "left").select(key, F.col("since").alias("a"), F.coalesce(F.date_sub("first", 1), "upto").alias("z"))
    return gaps.unionByName(head).where("a <= z").select(key, F.col("a").alias("first_day"), F.col("z").alias("last_day"))


def to_read(missing: DataFrame, there: DataFrame, key: str = "subscription_id") -> DataFrame:
    """key, day: the days of unread() runs that have arrived by now. ``there``: day."""
    days = missing.select(key, F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return days.join(there.select("day").distinct(), "day", "left_semi").select(key, "day")


def due(subscriptions: DataFrame, now: Column) -> DataFrame:
    """Active subscriptions whose time has come."""
    return subscriptions.where(F.col("is_active") & (F.col("next_run_at") <= now))


def missed(subscriptions: DataFrame, now: Column) -> DataFrame:
    """Active subscriptions whose time came within the last day."""
    return due(subscriptions, now).where(F.col("next_run_at") >= now - F.expr("interval 1 day"))


def high_water(tasks: DataFrame) -> DataFrame:
    """created_by, model_id, subscription_id, last: the end of the range of the newest task of each user and
    model; it counts for the subscription that the task was for."""
    newest = first_by_key(tasks, ["created_by", "model_id"], [F.desc("created_at"), F.desc("id")])
    return newest.select("created_by", "model_id", F.get_json_object("extra", "$.subscription_id").alias("subscription_id"), F.get_json_object("extra", "$.dateRange[1]").try_cast("date").alias("last"))


def own_high_water(tasks: DataFrame) -> DataFrame:
    """subscription_id, last: the latest end of all ranges of each subscription itself."""
    own = tasks.select(F.get_json_object("extra", "$.subscription_id").alias("subscription_id"), F.get_json_object("extra", "$.dateRange[1]").try_cast("date").alias("last"))
    return own.where("subscription_id IS NOT NULL").groupBy("subscription_id").agg(F.max("last").alias("last"))


def unfinished(tasks: DataFrame) -> DataFrame:
    """Tasks that aren't completed with a result, and so may run again."""
    return tasks.where(~((F.col("status") == "completed") & F.get_json_object("extra", "$.result_file_key").isNotNull()) | F.col("extra").isNull())
