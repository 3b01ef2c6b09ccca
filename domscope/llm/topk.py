"""Exact top-k by integer inner product, a block at a time.

1. Vectors are put in order of a code, the places and signs of their two largest components, then of their ids, so that
   similar ones are neighbours, and cut into shards, each of several blocks. A shard has a forward index - its ids and
   its matrix - and, for each block and for the shard as a whole, the largest and the smallest value of every term
   (component). For a query, the sum over terms of what it could gain at most there bounds all scores in the block.
2. Every query is searched in its own shard first, where its nearest neighbours are likely. Its k-th score there is
   its floor.
3. Only the bounds of shards, not their payload, meet the other queries. A query is sent on to those shards whose bound
   reaches its floor, and there takes the blocks in order of their bounds, until the bounds fall below its k-th score
   so far. Ties with that score go on, since a smaller id may still win.
4. Each search keeps k candidates a query, and these are merged by aggregates.

Lots of queries and groups of bounds have a fixed size, and each meeting is a row, so memory is bounded whatever the
number of either. Bounds save nothing on vectors without any structure, and nearly all on those that lie in clusters.

Rows whose vector is null, or holds a null or a non-finite component, take no part, and neither do those whose id is null.
Each row is a candidate of its own, also if others share its id; a query's own row is no candidate of it, others with its
id are. A query row gets its k best; ties go to the smaller id. Cells are 64-bit integers, so a component of which
``scale`` times does not fit in that is an error, as is a score among the best k that does not; products are exact
whatever their size. Very long vectors are used whole; of vectors of several lengths the shorter ones count as ending
in zeros. No vectors, or no queries: no rows. Other columns are left out, so no name clashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, lean, written

BLOCK = 256
BLOCKS_A_SHARD = 16
#: Queries in a lot, and shards in a group of bounds.
LOT = 512
GROUP = 256
_LEAST = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def as_integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x; null if one is null or not finite. An error if one is too large for int64,
    what cells hold: such a vector is never left out in silence."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    small = lambda x: F.abs(x.cast("double") * scale) < F.lit(2.0**63)
    whole = lambda x: F.floor(x.cast("double") * scale)
    return F.when(fine, F.transform(vector, lambda x: F.when(small(x), whole(x)).otherwise(F.raise_error(F.lit(f"a component times {scale} does not fit 64 bits")).cast("long"))))


def code(v: Column) -> Column:
    """A number that vectors share whose two largest components, by size, have the same places and signs."""
    size = F.transform(v, lambda x, k: F.struct(F.abs(x.cast("double")).alias("a"), (-k).alias("k"), (x < 0).alias("minus")))
    top = F.slice(F.sort_array(size, asc=False), 1, 2)
    return F.aggregate(top, F.lit(0).cast("long"), lambda n, t: n * 2_000_003 + (1 - t["k"]) * 2 + t["minus"].cast("int"))


def products(queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """All inner products, exact: in double where none can reach 2**53, in int64 below 2**63, else in Python's integers."""
    reach = float(np.abs(queries).astype(np.float64).max(initial=0)) * float(np.abs(cells).astype(np.float64).max(initial=0)) * max(1, cells.shape[1])
    if reach < 2**53:
        return (queries.astype(np.float64) @ cells.astype(np.float64).T).astype(np.int64)
    if reach < 2**62:
        return queries @ cells.T
    return queries.astype(object) @ cells.astype(object).T


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What no product of a query (row) with a vector between low and high (a column) exceeds."""
    return products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)


class Found:
    """The best k of each of some queries so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _LEAST)
        self.id = np.full((n, k), _MOST)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in scores, of the queries ``rows`` with the vectors ``ids``; those that are _LEAST are none."""
        if scores.dtype == object and self.score.dtype != object:
            self.score = self.score.astype(object)
        better = np.flatnonzero((scores.max(1) >= self.score[rows, -1]).astype(bool))
        rows = rows[better]
        both = np.concatenate([self.score[rows], scores[better]], 1)
        names = np.concatenate([self.id[rows], np.broadcast_to(ids, (len(rows), len(ids)))], 1)
        ordered = np.sort(both, axis=1) if both.dtype == object else np.partition(both, -self.k, axis=1)
        at, column = np.nonzero(((both >= ordered[:, -self.k][:, None]) & (both > _LEAST)).astype(bool))  # only these can be among the first k
        score, name = both[at, column], names[at, column]
        order = np.array(sorted(range(len(at)), key=lambda n: (at[n], -score[n], name[n])), np.int64) if score.dtype == object else np.lexsort((name, -score, at))
        at, score, name = at[order], score[order], name[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        first = place < self.k
        self.score[rows], self.id[rows] = _LEAST, _MOST
        self.score[rows[at[first]], place[first]] = score[first]
        self.id[rows[at[first]], place[first]] = name[first]


def search(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, cells: np.ndarray, ids: np.ndarray, k: int, block: int) -> tuple[Found, int, int]:
    """The best k of a shard for each query, and how many blocks were scored, of how many. ``own`` is the query's place in the shard,
    or -1; only scores of ``floor`` or more count."""
    starts = range(0, len(ids), block)
    high = np.stack([cells[b : b + block].max(0) for b in starts])
    low = np.stack([cells[b : b + block].min(0) for b in starts])
    limit = bounds(queries, high, low)
    order = np.argsort(-limit, axis=1, kind="stable")
    found = Found(len(queries), k)
    live, scored = np.arange(len(queries)), 0
    for turn in range(len(high)):
        pick = order[live, turn]
        kth = np.maximum(found.score[live, -1], floor[live])
        live = live[(limit[live, pick] >= kth).astype(bool)]
        if not len(live):
            break
        pick = order[live, turn]
        for b in np.unique(pick):
            rows = live[pick == b]
            scores = products(queries[rows], cells[b * block : (b + 1) * block])
            scored += len(rows)
            here = own[rows] - b * block
            inside = np.flatnonzero((here >= 0) & (here < scores.shape[1]))
            scores[inside, here[inside]] = _LEAST
            found.add(rows, scores, ids[b * block : (b + 1) * block])
    return found, scored, len(queries) * len(high)


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, np.int64).tobytes()


def _array(data: bytes, width: int | None = None) -> np.ndarray:
    a = np.frombuffer(data, np.int64)
    return a if width is None else a.reshape(-1, width)


_LOTS = "width long, query_rows binary, query_ids binary, floors binary, query_cells binary"


def shards(rows: DataFrame, size: int) -> DataFrame:
    """Of (row, id, v, q, code) one row per up to ``size`` neighbours: shard, width, ids, cells, rows, queries (flags),
    high, low; numbers as int64 bytes."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.select("row", "id", "v", "q", "code").repartitionByRange(parts, "code", "id", "row").sortWithinPartitions("code", "id", "row").drop("code")

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        number, names = TaskContext.get().partitionId() << 33, ["shard", "width", "ids", "cells", "rows", "queries", "high", "low"]
        held: list[tuple] = []

        def shard() -> pa.RecordBatch:
            cells = np.zeros((len(held), max(1, max(len(v) for _, _, v, _ in held))), np.int64)
            for k, (_, _, v, _) in enumerate(held):
                cells[k, : len(v)] = v
            row, i, _, q = zip(*held)
            blobs = [np.array(i), cells, np.array(row), np.array(q, np.int64), cells.max(0), cells.min(0)]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([cells.shape[1]]), *(pa.array([_bytes(x)], pa.binary()) for x in blobs)], names)

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(x)
                if len(held) == size:
                    yield shard()
                    held, number = [], number + 1
        if held:
            yield shard()

    return ordered.mapInArrow(lean(run), "shard long, width long, ids binary, cells binary, rows binary, queries binary, high binary, low binary")


def _results(found: Found, rows: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    at, n = np.nonzero(found.score > _LEAST)
    scores = found.score[at, n].tolist()
    if any(abs(s) > _MOST for s in scores):
        raise OverflowError("a score does not fit 64 bits")
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows[at], ids[at], found.id[at, n], scores)], ["query_row", "query_id", "vec_id", "score"])


_FOUND = "query_row long, query_id long, vec_id long, score long"


def _at_home(index: DataFrame, k: int, block: int) -> DataFrame:
    """Of each shard one row: what its queries find there (array found), and these queries as lots with their floors (array lots)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for x in range(batch.num_rows):
                width, ids, cells, rows, flags = (c[x].as_py() for c in batch.columns)
                ids, cells, rows = _array(ids), _array(cells, width), _array(rows)
                own = np.flatnonzero(_array(flags))
                for a in range(0, len(own), LOT):
                    mine = own[a : a + LOT]
                    found, _, _ = search(cells[mine], mine, np.full(len(mine), _LEAST), cells, ids, k, block)
                    hits = _results(found, rows[mine], ids[mine])
                    floors = np.array([min(max(s, _LEAST), _MOST) for s in found.score[:, -1].tolist()], np.int64)
                    lot = [width, *map(_bytes, (rows[mine], ids[mine], floors, cells[mine]))]
                    yield pa.RecordBatch.from_arrays([pa.array([hits.to_pylist()], pa.list_(_RECORD)), *(pa.array([c]) for c in lot)], ["found", *_LOT_NAMES])

    return index.select("width", "ids", "cells", "rows", "queries").mapInArrow(lean(run), f"found array<struct<{_FOUND.replace(' long', ': long')}>>, {_LOTS}")


_RECORD = pa.struct([(x.split()[0], pa.int64()) for x in _FOUND.split(", ")])
_LOT_NAMES = [x.split()[0] for x in _LOTS.split(", ")]


def _wide(a: np.ndarray, to: int) -> np.ndarray:
    return a if a.shape[1] == to else np.pad(a, ((0, 0), (0, to - a.shape[1])))


def _reached(lots: DataFrame, index: DataFrame) -> DataFrame:
    """shard and lot: of each lot the queries whose floor the shard's bound reaches, but for shards without any. Lots, and groups of
    GROUP shards' bounds, meet all with all, dealt over lots and groups."""
    spark = lots.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = index.count()
    groups = max(1, -(-n // GROUP))
    salts = max(1, -(-parts // groups))
    limits = index.select("shard", "width", "high", "low", "rows").withColumn("grp", F.pmod(F.xxhash64("shard"), F.lit(groups)))
    packed = limits.groupBy("grp").agg(F.collect_list(F.struct("shard", "width", "high", "low", "rows")).alias("limits"))  # about GROUP of them
    packed = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = lots.withColumn("salt", F.pmod(F.xxhash64("query_rows"), F.lit(salts)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for x in range(batch.num_rows):
                w, rows, ids, floors, cells = (c[x].as_py() for c in batch.columns[:5])
                rows, ids, floors, cells = _array(rows), _array(ids), _array(floors), _array(cells, w)
                for s in batch.column(5)[x].as_py():
                    width = max(w, s["width"])
                    limit = bounds(_wide(cells, width), _wide(_array(s["high"], s["width"]), width), _wide(_array(s["low"], s["width"]), width))[:, 0]
                    go = np.flatnonzero((limit >= floors).astype(bool) & ~np.isin(rows, _array(s["rows"])))
                    if len(go):
                        lot = [s["shard"], w, *map(_bytes, (rows[go], ids[go], floors[go], cells[go]))]
                        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in lot], ["shard", *_LOT_NAMES])

    return spread.join(packed, ["grp", "salt"]).select(*_LOT_NAMES, "limits").mapInArrow(lean(run), f"shard long, {_LOTS}")


def _abroad(lots: DataFrame, index: DataFrame, k: int, block: int) -> DataFrame:
    """What queries find in the shards that they were sent to, and in a row without names how many blocks were scored, of how many."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for x in range(batch.num_rows):
                w, rows, own, floors, queries, width, ids, cells = (c[x].as_py() for c in batch.columns)
                to = max(w, width)
                queries, rows = _wide(_array(queries, w), to), _array(rows)
                found, scored, of = search(queries, np.full(len(rows), -1), _array(floors), _wide(_array(cells, width), to), _array(ids), k, block)
                yield _results(found, rows, _array(own))
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (None, None, scored, of)], ["query_row", "query_id", "vec_id", "score"])

    return lots.join(index.select("shard", F.col("width").alias("to"), "ids", "cells"), "shard").select(*_LOT_NAMES, "to", "ids", "cells").mapInArrow(lean(run), _FOUND)


def search_all(vectors: DataFrame, is_query: Column, k: int, scale: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """All candidates (query_row, query_id, vec_id, score), and one row (scored, searched, blocks): query-block pairs that were scored
    after the first search, those of the shards that queries were sent to, and all there are."""
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), as_integers(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).cast("long").alias("q"))
    rows = numbered.where("id IS NOT NULL AND v IS NOT NULL").withColumn("code", code(F.col("v")))
    index = written(shards(rows, BLOCK * BLOCKS_A_SHARD), "shards")
    home = written(_at_home(index, k, BLOCK), "lots")
    away = written(_abroad(_reached(home.drop("found"), index), index, k, BLOCK), "away")
    found = home.select(F.inline("found")).unionByName(away.where("query_row IS NOT NULL"))
    blocks = index.agg(F.coalesce(F.sum(F.ceil(F.length("ids") / 8 / BLOCK)), F.lit(0)).alias("b"), F.coalesce(F.sum(F.expr("aggregate(sequence(0, length(queries) div 8 - 1), 0L, (n, i) -> n + if(substr(queries, i * 8 + 1, 1) = X'01', 1, 0))")), F.lit(0)).alias("q"))
    seen = away.where("query_row IS NULL").agg(F.coalesce(F.sum("vec_id"), F.lit(0)).alias("scored"), F.coalesce(F.sum("score"), F.lit(0)).alias("searched"))
    return found, seen.join(blocks.select((F.col("b") * F.col("q")).alias("blocks")), how="left")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each row that ``is_query`` picks,
    among all rows but itself; ties to the smaller id."""
    found, _ = search_all(vectors, is_query, k, scale, id_col, vector_col)
    first = F.slice(F.sort_array(F.collect_list(F.struct("minus", "vec_id"))), 1, k).alias("best")
    some = found.withColumn("minus", -F.col("score").cast("decimal(20)")).groupBy("query_row", "query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("slot")).agg(first)
    best = some.select("query_row", "query_id", F.inline("best")).groupBy("query_row", "query_id").agg(first)
    return best.select("query_id", F.posexplode("best").alias("place", "b")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).cast("long").alias("score"))
