"""Deletion of repeated runs of lines, by a suffix array over the sequences of line ids.

A run weighs as many words as it has, and each of its lines at least one. A run of whole, neighbouring lines
that weighs ``min_words`` or more and that occurs earlier too - in a document with a smaller id, or further up
in the same one - is deleted; the first copy stays. Copies may overlap, so of a line that repeats on and on
only the beginning of the first run stays.

1. Texts that equal an earlier one as a whole are settled at once: they are deleted if they weigh enough.
2. Lines get ids by a hash of 128 bits. Lines that occur once end every run and drop out.
3. Prefix doubling: the suffixes that begin at the remaining lines are ranked by their first line, then by
   their first 2, 4, 8 ... lines, each time by pairs of ranks; the distinct pairs, of which there are few,
   are sorted by range. Suffixes whose first 2**k lines nobody shares have a place of their own in the suffix
   array and drop out. This ends when no suffix is left, or when blocks are long enough for step 4: no run that just
   reaches the weight has more lines than words, so longer prefixes can't tell anything more about what is deleted.
4. The suffixes that share their first n lines are an interval of the suffix array in which the longest common
   prefixes are at least n. It is named by the ranks of two blocks of 2**k lines that cover the n lines. Any
   maximal repeated run of enough weight is the union of runs that just reach the weight, counted from a line
   downwards or upwards, so the intervals of these show all of it; the smallest place in an interval is the
   first copy, all others are deleted.

Only sums by key, joins on unique keys, and joins whose hot keys Spark can split are used; the joins are
merge joins at every size, since nothing here has a size that is known to be small. A document is taken
as one row: two rows with the same id are two documents, in no given order. Null ids come first. Null texts
have no lines. Line ends are \\n alone; line ends before a deleted run go with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, written

MIN_WORDS = 50


def _ranked(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows with a rank that grows with the keys; partitions are sorted ranges."""
    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(distinct.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), name)


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, digest of the text, and its lines as array of (a, b: hash, weight)."""
    line = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"), F.greatest(F.regexp_count(x, F.lit(r"[^ \t\r]+")), F.lit(1)).alias("weight"))
    return docs.where(F.col(text_col).isNotNull()).select("row", F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("digest"), F.transform(F.split(text_col, "\n", -1), line).alias("lines"))


def suffix_ranks(lines: DataFrame, longest: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Of (row, id, pos, a, b, weight): the rows whose line repeats, and for each k (row, pos, rank) of the
    suffixes whose first 2**k lines repeat. Ranks order the suffixes by these lines. Doubling ends when no suffix is
    shared, or when two blocks of 2**k lines cover ``longest`` lines, the most that any run asks for."""
    repeated = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ids = _ranked(repeated, ["a", "b"], "line-ids")
    kept = written(lines.join(ids.hint("merge"), ["a", "b"]).select("row", "id", "pos", "weight", "rank"), "repeated-lines")
    levels = [kept.select("row", "pos", "rank")]
    while longest is None or 2 ** len(levels) <= longest:
        reach = 2 ** (len(levels) - 1)
        ahead = W.partitionBy("row").orderBy("pos").rangeBetween(reach, reach)
        pairs = levels[-1].select("row", "pos", F.col("rank").alias("r1"), F.max("rank").over(ahead).alias("r2")).where("r2 IS NOT NULL")
        shared = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        names = _ranked(shared, ["r1", "r2"], "pairs")
        if names.isEmpty():
            break
        levels.append(written(pairs.join(names.hint("merge"), ["r1", "r2"]).select("row", "pos", "rank"), "ranks"))
        forget(names)
    return kept, levels


def just_enough(kept: DataFrame, min_words: int) -> DataFrame:
    """row, id, start, n: the shortest runs of repeated lines with the weight, from each line down and up."""
    of_row = W.partitionBy("row").orderBy("pos")
    spans = kept.withColumn("part", F.col("pos") - F.row_number().over(of_row))
    whole = W.partitionBy("row", "part")
    sums = spans.withColumn("upto", F.sum("weight").over(whole.orderBy("pos"))).withColumn("before", F.col("upto") - F.col("weight"))
    sums = sums.withColumns(
        {
            "next": F.min("pos").over(whole.orderBy("before").rangeBetween(min_words, W.unboundedFollowing)),
            "last": F.max("pos").over(whole),
            "total": F.max("upto").over(whole),
            "prior": F.max("pos").over(whole.orderBy("upto").rangeBetween(W.unboundedPreceding, -min_words)),
            "first": F.min("pos").over(whole),
        }
    )
    end = F.when(F.col("next").isNotNull(), F.col("next") - 1).when(F.col("total") - F.col("before") >= min_words, F.col("last"))
    start = F.when(F.col("prior").isNotNull(), F.col("prior") + 1).when(F.col("upto") >= min_words, F.col("first"))
    both = sums.where(F.col("total") >= min_words).select("row", "id", F.explode(F.array(F.struct(F.col("pos").alias("start"), end.alias("end")), F.struct(start.alias("start"), F.col("pos").alias("end")))).alias("run"))
    return both.where("run.start IS NOT NULL AND run.end IS NOT NULL").selectExpr("row", "id", "run.start AS start", "run.end - run.start + 1 AS n").distinct()


def later_copies(runs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """row, start, n of the runs that aren't the first in their interval."""
    ranks = levels[0].withColumn("k", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(level.withColumn("k", F.lit(k)))
    blocks = runs.withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int")).withColumn("pos", F.col("start"))
    first = blocks.join(ranks.withColumnRenamed("rank", "r1").hint("merge"), ["row", "k", "pos"]).withColumn("pos", (F.col("start") + F.col("n") - F.expr("shiftleft(1, k)")).cast("int"))
    named = written(first.join(ranks.withColumnRenamed("rank", "r2").hint("merge"), ["row", "k", "pos"]).select("row", "id", "start", "n", "r1", "r2"), "intervals")
    place = F.struct("id", "row", "start")
    heads = written(named.groupBy("n", "r1", "r2").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "heads")
    return named.join(heads.hint("merge"), ["n", "r1", "r2"]).where("NOT (row = head.row AND start = head.start)").select("row", "start", "n")


def repeated_ranges(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """row, ranges array<struct<first, last>> (lines from 0): what is deleted of each document. ``docs`` has
    a column row that tells its rows apart."""
    table = written(line_table(docs, id_col, text_col), "lines")
    heads = written(table.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "texts")
    copies = table.join(heads.hint("merge"), "digest").where("row <> head.row").select("row", F.size("lines").alias("n"), F.aggregate("lines", F.lit(0), lambda t, x: t + x["weight"]).alias("weight"))
    copies = written(copies, "whole-copies")
    lines = table.join(copies.select("row").hint("merge"), "row", "left_anti").select("row", "id", F.posexplode("lines").alias("pos", "line")).select("row", "id", "pos", "line.*")
    kept, levels = suffix_ranks(lines, max(1, min_words))  # a line weighs one word at least
    runs = later_copies(just_enough(kept, min_words), levels)
    gone = runs.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    islands = gone.withColumn("part", F.col("pos") - F.row_number().over(W.partitionBy("row").orderBy("pos"))).groupBy("row", "part").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    whole = copies.where(F.col("weight") >= min_words).select("row", F.array(F.struct(F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))).alias("ranges"))
    some = islands.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    return some.unionByName(whole)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from the text, and the columns n_lines and n_removed, which
    ``counts`` may name otherwise. Columns of these names are replaced, and one named __row is left out."""
    rows = written(docs.drop(*counts, "__row").withColumn("__row", F.monotonically_increasing_id()), "documents")
    slim = rows.select(F.col("__row").alias("row"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    ranges = written(repeated_ranges(slim, "__id", "__text", min_words), "ranges").withColumnRenamed("row", "__row").withColumnRenamed("ranges", "__ranges")
    joined = rows.join(ranges.hint("merge"), "__row", "left")
    lines = F.split(text_col, "\n", -1)
    left = F.filter(lines, lambda x, k: ~F.exists("__ranges", lambda r: k.between(r["first"], r["last"])))
    removed = F.coalesce(F.aggregate("__ranges", F.lit(0).cast("long"), lambda t, r: t + r["last"] - r["first"] + 1), F.lit(0))
    return joined.select(
        *[F.when(F.col("__ranges").isNull(), F.col(c)).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in rows.columns if c != "__row"],
        F.coalesce(F.regexp_count(text_col, F.lit("\n")) + 1, F.lit(0)).cast("long").alias(counts[0]),
        removed.alias(counts[1]),
    )
