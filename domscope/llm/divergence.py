"""How far the sources of a language differ in their words: counts and divergences by shards, in DuckDB.

A map task counts terms by (lang, source), with the documents that have them, in a DuckDB of its own and hands on
sums. Rows are then hashed by (lang, term): a shard has all counts of its terms, so SQL there knows how many documents
of the language have a term and keeps the terms with ``min_docs``. The kept counts are stored; their sums give each group's
size N and each language's number of terms V. In a second pass over the same shards SQL turns counts into shares and
sums f over the terms of the shard for each two sources of a language, and ranks the shard's terms for each source. Spark
adds the partial sums and ranks them.

A share is p = 1 + floor(10^9 (count + 2) / (N + 2V)), f = floor((p - q)^2 / (p + q)), in integers. A source that lacks a
term has a share all the same, equal for all such terms, so a shard needs no row for it: the sum over all terms is V times f of
those two shares, plus for each source the change by its counts (once for each count that occurs, however many terms have it), plus,
for the terms that both have, what is left. What a shard hands on is one row for each two sources of a language, as the
result is; groups come to the shards by a shuffle, since their number isn't bounded.

Null text, lang and source count as ''. Texts without terms, empty ones too, still make their (lang, source) a group; very long
texts are cut between words into pieces before SQL splits them. Repeated rows count each. Of equal values the smaller item comes
first, in UTF-8 order. A language with one source has no pairs, one without kept terms has pairs of value 0. An empty
table gives an empty result. Other columns are left out, so no name clashes.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batches, lean, written

#: Bytes of text that SQL splits at a time, and of one value in it.
SLICE, PIECE = 4_000_000, 64_000
#: Rows of counts that a map task holds before it sums them, and those it hands on early if they are still more than half.
HELD = 1_000_000
#: What a task's DuckDB may take before it spills to the task's own temporary folder.
MEMORY = "256MB"

#: For bytes.translate(): ASCII other than letters becomes a space, A-Z becomes a-z. No other character has ASCII bytes.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

_COUNTED = "lang string, source string, term string, n long, docs long"
_KEPT = "lang string, source string, term string, n long"
_PARTIAL = "part string, lang string, source string, item string, value long"


@contextmanager
def _database() -> Iterator[duckdb.DuckDBPyConnection]:
    own = tempfile.mkdtemp(prefix="shard-")
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": own, "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(own, ignore_errors=True)


def _fetched(con: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``sql`` in batches."""
    for batch in con.sql(sql).to_arrow_reader(50_000):
        if batch.num_rows:
            yield batch


def _held(con: duckdb.DuckDBPyConnection) -> int:
    return con.execute("SELECT count(*) FROM counts").fetchall()[0][0]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, pa.Table]]:
    """From row, to row, and a table (row, piece) of their letters, lower-cased, words divided by spaces."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data, at = memoryview(texts.buffers()[2] or b""), 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        first = int(ends[at])
        letters = bytes(data[first : int(ends[upto])]).translate(_LETTERS)
        cuts, rows = [0], []
        for row in range(at, upto):
            end = int(ends[row + 1]) - first
            while end - cuts[-1] > PIECE:
                cut = letters.find(b" ", cuts[-1] + PIECE, end)
                if cut < 0:
                    break
                cuts.append(cut)
                rows.append(row)
            cuts.append(end)
            rows.append(row)
        piece = pa.StringArray.from_buffers(len(rows), pa.py_buffer(np.array(cuts, np.int32)), pa.py_buffer(letters))
        yield at, upto, pa.table({"row": pa.array(rows, pa.int32()), "piece": piece})
        at = upto


#: Terms of a slice by group. A row with the term '' says that the group occurs.
_COUNT = """
INSERT INTO counts
SELECT lang, source, term, sum(n), count(*)
FROM (SELECT row, term, count(*) AS n FROM (SELECT row, unnest(string_split(piece, ' ')) AS term FROM pieces) WHERE term <> '' GROUP BY ALL)
JOIN docs USING (row) GROUP BY ALL
UNION ALL SELECT DISTINCT lang, source, '', 0, 0 FROM docs
"""
_SUMS = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL"


def _count(batches: Batches) -> Batches:
    """Batches of (lang, source, text) to sums of _COUNTED."""
    with _database() as con:
        con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for batch in batches:
            for at, upto, pieces in _pieces(batch.column(2)):
                docs = pa.table({"row": pa.array(range(at, upto), pa.int32()), "lang": batch.column(0).slice(at, upto - at), "source": batch.column(1).slice(at, upto - at)})
                con.register("docs", docs)
                con.register("pieces", pieces)
                con.execute(_COUNT)
                if _held(con) > HELD:
                    con.execute(f"CREATE TABLE summed AS {_SUMS}; DROP TABLE counts; ALTER TABLE summed RENAME TO counts")
                    if _held(con) > HELD // 2:
                        yield from _fetched(con, "FROM counts")
                        con.execute("TRUNCATE counts")
        yield from _fetched(con, _SUMS)


def _keep(min_docs: int):
    """Shards of _COUNTED to _KEPT: the counts of kept terms by source, those of the language under a null source,
    and a row with the term '' for each group."""
    sql = f"""
    SELECT lang, source, term, n FROM counts WHERE term = ''
    UNION ALL
    SELECT lang, source, term, sum(n)::BIGINT FROM counts JOIN (SELECT lang, term FROM counts WHERE term <> '' GROUP BY ALL HAVING sum(docs) >= {min_docs}) USING (lang, term)
    GROUP BY GROUPING SETS ((lang, source, term), (lang, term))
    """

    def run(batches: Batches) -> Batches:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
        with _database() as con:
            rows = pa.RecordBatchReader.from_batches(schema, (pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches))
            con.register("arriving", rows)
            con.execute("CREATE TABLE counts AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM arriving GROUP BY ALL")
            yield from _fetched(con, sql)

    return run


#: Of a shard: g has its groups, the language itself under a null source, with N, V and the share p0 of a term that the group
#: lacks; c the counts of its terms with their shares.
_SHARES = """
CREATE MACRO share(n, size, terms) AS (1 + 1000000000::HUGEINT * (n + 2) // (size + 2 * terms))::BIGINT;
CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // (p + q);
CREATE TABLE g AS SELECT DISTINCT lang, source, n AS size, terms, share(0, n, terms) AS p0 FROM arrived WHERE term IS NULL AND terms > 0;
CREATE TABLE c AS SELECT a.lang, a.source, a.term, share(a.n, g.size, g.terms) AS p, g.p0
  FROM arrived a JOIN g ON a.lang = g.lang AND a.source IS NOT DISTINCT FROM g.source WHERE a.term IS NOT NULL;
DROP TABLE arrived;
"""
_PAIRS = """
WITH m AS (SELECT lang, count(*) AS m FROM c WHERE source IS NULL GROUP BY lang),
own AS (SELECT lang, source, p, p0, count(*) AS k FROM c WHERE source IS NOT NULL GROUP BY ALL),
sums AS (
  SELECT a.lang, a.source, b.source AS item, m * f(a.p0, b.p0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source < b.source JOIN m ON m.lang = a.lang
  UNION ALL
  SELECT own.lang, least(own.source, g.source), greatest(own.source, g.source), k * (f(own.p, g.p0) - f(own.p0, g.p0))
  FROM own JOIN g ON own.lang = g.lang AND own.source <> g.source
  UNION ALL
  SELECT a.lang, a.source, b.source, f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0)
  FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source)
SELECT 'pair' AS part, lang, source, item, sum(value)::BIGINT AS value FROM sums GROUP BY ALL
"""
_TERMS = """
SELECT 'term' AS part, a.lang, a.source, a.term AS item, f(a.p, q.p) AS value
FROM c a JOIN c q ON a.lang = q.lang AND a.term = q.term AND q.source IS NULL WHERE a.source IS NOT NULL AND a.p > q.p
QUALIFY row_number() OVER (PARTITION BY a.lang, a.source ORDER BY value DESC, item) <= {top}
"""


def _partial(top: int):
    """Shards of (lang, source, term, n, terms) to partial sums and the shard's first terms, _PARTIAL."""

    def run(batches: Batches) -> Batches:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("terms", pa.int64())])
        with _database() as con:
            rows = pa.RecordBatchReader.from_batches(schema, (pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches))
            con.register("arriving", rows)
            con.execute("CREATE TABLE arrived AS FROM arriving")
            con.execute(_SHARES)
            yield from _fetched(con, _PAIRS)
            yield from _fetched(con, _TERMS.format(top=top))

    return run


def divergences(docs: DataFrame, min_docs: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value long, rank int: for each (lang, source) that occurs, by descending value, every other source of the
    language (part ``pair``, f summed over all kept terms) and its ``top`` terms with a larger share than in the language (part ``term``)."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for a, c in (("lang", lang), ("source", source), ("text", text))])
    counted = rows.mapInArrow(lean(_count), _COUNTED)
    kept = written(counted.repartition(shards, "lang", "term").mapInArrow(lean(_keep(min_docs)), _KEPT), "counts")
    terms = kept.where("term <> ''")
    sizes = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    groups = kept.where("term = ''").select("lang", "source").distinct()
    whole = sizes.where("source IS NULL").select("lang", F.col("n").alias("all_n"), F.col("k").alias("all_k"))
    sized = groups.join(sizes.where("source IS NOT NULL"), ["lang", "source"], "left").join(whole, "lang", "left")
    sized = sized.select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("all_k", F.lit(0)).cast("long").alias("terms"))
    sized = written(sized.unionByName(whole.select("lang", F.lit(None).cast("string").alias("source"), F.col("all_n").alias("n"), F.col("all_k").alias("terms"))), "sizes")

    shard = F.pmod(F.hash("lang", "term"), F.lit(shards))
    spread = sized.where("terms > 0").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), "n", "terms")
    arriving = terms.select(shard.alias("shard"), "lang", "source", "term", "n", F.lit(None).cast("long").alias("terms")).unionByName(spread)
    partial = arriving.repartitionById(shards, F.col("shard")).drop("shard").mapInArrow(lean(_partial(top)), _PARTIAL)
    partial = written(partial, "partial")

    other = groups.withColumnRenamed("source", "item")
    none = groups.join(other, "lang").where("source < item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    sums = partial.where("part = 'pair'").drop("part").unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    both = pairs.unionByName(partial.where("part = 'term'")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= F.when(F.col("part") == "term", top).otherwise(F.col("rank")))
    return both.select("lang", "source", "part", "item", "value", "rank")
