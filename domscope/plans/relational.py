"""Building blocks: fallbacks, ranks within keys, paging, and tables rewritten instead of updated."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored


def all_of(terms: Iterable[Column | None]) -> Column:
    """The conjunction of the terms that are given; true without any."""
    out = F.lit(True)
    for t in terms:
        if t is not None:
            out = out & t
    return out


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``primary``, or ``fallback`` if it has no rows. The test is a scalar sub-query of one row, so
    nothing is decided on the driver."""
    some = primary.select(F.lit(1).alias("__one")).limit(1).agg(F.count("__one").alias("__some"))
    rest = fallback.join(F.broadcast(some), F.col("__some") == 0).drop("__some")
    return primary.unionByName(rest.select(*primary.columns))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the row's rank within its keys."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return ranked(df, keys, order, "__rank").where("__rank = 1").drop("__rank")


def latest_by_key(df: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """One row for each key: that with the largest ``when``, then ``tie``. An aggregate, so hot keys are
    reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    # Null times come last, as they would in a descending sort.
    best = F.max_by(F.struct(*rest), F.struct(F.col(when).isNotNull(), F.col(when), F.col(tie)))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def top_by_key(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """At most k rows for each key, with their rank. Spark filters ranks before the shuffle too."""
    return ranked(df, keys, order, name).where(F.col(name) <= k)


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 1000) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows. ``order`` must be total for pages to be disjoint."""
    if number < 1 or not 1 <= size <= most:
        raise ValueError(f"pages count from 1 and have 1 to {most} rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def whitelisted(name: str | None, allowed: Iterable[str], default: str) -> str:
    """``name`` if it is allowed, else the default."""
    return name if name in set(allowed) else default


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with those of ``rows`` whose key it lacks, one for each key."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new.select(*table.columns))


def update_rows(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """``table`` with new values where the condition holds."""
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def update_from(table: DataFrame, source: DataFrame, key: Column, only_blank: bool = False, **values: str) -> DataFrame:
    """``table`` with columns taken from the row of ``source`` that matches ``key`` on t and s, where that has
    a value; with ``only_blank`` only where the table has none. ``source`` has one row for each key."""
    joined = table.alias("t").join(source.alias("s"), key, "left")
    out = []
    for c in table.columns:
        old = F.col(f"t.`{c}`")
        if c not in values:
            out.append(old)
            continue
        new = F.col(f"s.`{values[c]}`")
        blank = old.isNull() | (F.trim(old.cast("string")) == "")
        out.append((F.when(blank, F.coalesce(new, old)).otherwise(old) if only_blank else F.coalesce(new, old)).alias(c))
    return joined.select(*out)


def delete_cascading(gone: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each child table without the rows that point to a key of ``gone``."""
    keys = gone.select(F.col(key).alias("__gone")).distinct()
    return {name: df.join(keys, df[c] == keys["__gone"], "left_anti") for name, (df, c) in children.items()}


def missing_from(rows: DataFrame, key: str, *others: tuple[DataFrame, str]) -> DataFrame:
    """The rows whose key no other table has; null keys of the others play no part."""
    for df, c in others:
        have = df.where(F.col(c).isNotNull()).select(F.col(c).alias("__have"))
        rows = rows.join(have, rows[key] == have["__have"], "left_anti")
    return rows


def numbered(df: DataFrame, key: str, name: str, by: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """``df`` with a column ``name`` that counts its rows from 1, for each value of ``by`` if given, in an order that a
    hash of the key fixes. A task sorts a bucket of hashes, never all rows; of rows with equal keys any comes first."""
    by = by or []
    b = df.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    sums = b.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bucket").alias("__b"), (F.sum("__n").over(W.partitionBy(*by).orderBy("__bucket")) - F.col("__n")).alias("__before"))
    placed = b.withColumn("__place", F.row_number().over(W.partitionBy(*by, "__bucket").orderBy(key, F.xxhash64(*df.columns))))
    same = F.col("__bucket") == F.col("__b")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return placed.join(before, same).select(*df.columns, (F.col("__before") + F.col("__place")).alias(name))


def in_order(df: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """``df``, stored, with a column ``name`` that counts its rows from 1 by ``order`` (nulls first), for each value of ``by`` if given. Rows
    are sorted by ranges, and what is before a range is a sum over ranges, so no value of ``by`` has to fit in a task."""
    by, row = by or [], "__row"
    sort = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    kept = stored(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn(row, F.monotonically_increasing_id()), "in-order")
    part = F.call_function("shiftright", F.col(row), F.lit(33))
    own = [F.col(c).alias(f"__{c}") for c in by]
    sums = kept.groupBy(*own, part.alias("__part")).agg(F.min(row).alias("__low"), F.count(F.lit(1)).alias("__n"))
    window = W.partitionBy(*[f"__{c}" for c in by]).orderBy("__part")
    before = sums.withColumn("__before", F.sum("__n").over(window) - F.col("__n"))
    same = all_of([part == F.col("__part"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]])
    return kept.join(before, same).select(*df.columns, (F.col(row) - F.col("__low") + F.col("__before") + 1).alias(name))
