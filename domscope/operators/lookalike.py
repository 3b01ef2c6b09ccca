"""Names that imitate official domains: an edit-distance filter, then similarity of embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import MATCH_TYPE, similarity_text
from ..functions.names import MOST_EDITS, char_grams, edits_of_length, key_domain, similarity_bound
from ..session import stored
from . import edit_index

#: The dimension of the default embedding.
DIMENSION = 64
#: About so many targets and candidates are in a pack; so many candidates of it are compared at once.
LOT, CANDIDATES, ROWS = 4096, 1024, 256
#: Lots, and numbers in their directions together, at most.
LOTS, CELLS = 1024, 1_000_000
#: Scores that differ by rounding alone are equal.
EQUAL = 1e-12


def official_targets(official: DataFrame, company: str = "company", domain: str = "domain", position: str = "position") -> DataFrame:
    """company, target, ord: one row for each lower-case name; the last company of a name wins, the first
    place is kept."""
    rows = official.withColumn("target", F.lower(F.trim(domain))).where("target <> ''")
    return rows.groupBy("target").agg(F.max_by(company, position).alias("company"), F.min(position).alias("ord"))


def within_reach(candidates: DataFrame, targets: DataFrame, domain: str = "domain", target: str = "target", itself: bool = True) -> DataFrame:
    """The candidates whose key is within the edits that some target's key allows - a target of another name, if
    ``itself`` is false. Keys meet by segments, see edit_index."""
    own = candidates.select(F.col(domain).alias("name"), key_domain(F.trim(domain)).alias("key")).where("key IS NOT NULL").distinct()
    known = targets.select(F.col(target).alias("name"), key_domain(F.col(target)).alias("key")).where("key IS NOT NULL")
    near = edit_index.near_some(own, known, edits_of_length, MOST_EDITS, itself).select("name")
    return candidates.join(near, F.col(domain) == F.col("name"), "left_semi")


def hashed_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """The default embedding: counts of character trigrams by a hash, the first four hex digits of MD5. Another one - a model behind
    a pandas UDF - may take its place."""
    slots = F.transform(char_grams(text), lambda g: (F.conv(F.substring(F.md5(g.cast("binary")), 1, 4), 16, 10).cast("int") % dimension))
    return F.aggregate(slots, F.array_repeat(F.lit(0.0), dimension), lambda counts, s: F.transform(counts, lambda n, k: n + (k == s).cast("double")))


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column as rows of length 1, shorter ones with zeros at the end; a zero vector stays."""
    m = np.zeros((len(column), width))
    for k, v in enumerate(column.to_pylist()):
        m[k, : len(v)] = v
    m /= np.maximum(np.abs(m).max(1, initial=0), np.finfo(float).tiny)[:, None]
    return m / np.maximum(np.sqrt((m * m).sum(1)), np.finfo(float).tiny)[:, None]


def nearest(names: list, own: np.ndarray, targets: list, cells: np.ndarray, itself: bool = True) -> list[tuple[int, float]]:
    """Row of the best target and its score for each candidate, the first of those within EQUAL; -1 if there is none."""
    out: list[tuple[int, float]] = []
    rows_of: dict = {}
    for k, t in enumerate(targets):
        rows_of.setdefault(t, []).append(k)
    for at in range(0, len(names), ROWS):
        part = own[at : at + ROWS]
        scores = part @ cells.T
        if not itself:
            for k, n in enumerate(names[at : at + ROWS]):
                scores[k, rows_of.get(n, [])] = -np.inf
        top = scores.max(1)
        best = (scores >= top[:, None] - EQUAL).argmax(1)
        exact = (part * cells[best]).sum(1)  # the same for equal vectors, wherever they lie
        out += [(int(b), float(x)) if t > -np.inf else (-1, 0.0) for b, x, t in zip(best, exact, top)]
    return out


def _matrix(cells: pa.Array) -> np.ndarray:
    """Stored vectors as rows."""
    return np.frombuffer(b"".join(cells.to_pylist())).reshape(len(cells), -1) if len(cells) else np.zeros((0, 1))


def _vectors(df: DataFrame, weights: dict[str, float], widths: dict[str, int]) -> DataFrame:
    """name, ord, cells, stored: one vector for all ``weights``, of whose products the weighted sum of cosines is made."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.concatenate([np.sqrt(w) * _unit(batch.column(x), widths[x]) for x, w in weights.items()], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("ord"), pa.array([row.tobytes() for row in cells], pa.binary())], ["name", "ord", "cells"])

    return stored(df.mapInArrow(run, f"name {kinds['name']}, ord {kinds['ord']}, cells binary"), "vectors")


def _packed(vectors: DataFrame, most: int) -> DataFrame:
    """lot, names, ords, cells: the vectors of each lot in packs of about ``most``. ``vectors`` is stored."""
    kinds = dict(vectors.dtypes)
    chunks = vectors.groupBy("lot").agg(F.ceil(F.count(F.lit(1)) / most).alias("chunks"))
    dealt = vectors.join(chunks, "lot").withColumn("chunk", F.pmod(F.xxhash64("name", F.lit("chunk")), F.col("chunks")))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ord", "ascending"), ("name", "ascending")])
        lists = [pa.array([table[c].to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("name", "ord")]
        return pa.table([table["lot"][:1], *lists, pa.array([b"".join(table["cells"].to_pylist())], pa.binary())], ["lot", "names", "ords", "cells"])

    return dealt.groupBy("lot", "chunk").applyInArrow(pack, f"lot int, names array<{kinds['name']}>, ords array<{kinds['ord']}>, cells binary")


def _met(own: DataFrame, lots: DataFrame, itself: bool) -> DataFrame:
    """name, target, ord, similarity of the best target of the lot for each candidate that was sent to it."""
    kinds = dict(own.dtypes), dict(lots.dtypes)
    name, target, order = (k[x].removeprefix("array<")[:-1] for k, x in ((kinds[0], "names"), (kinds[1], "names"), (kinds[1], "ords")))
    pairs = own.select("lot", F.col("names").alias("own"), F.col("cells").alias("own_cells")).join(lots, "lot").select("own", "own_cells", "names", "ords", "cells")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(x).type.value_type for x in ("own", "names", "ords")]
            for k in range(batch.num_rows):
                o, oc, n, d, nc = (col[k].as_py() for col in batch.columns)
                found = nearest(o, np.frombuffer(oc).reshape(len(o), -1), n, np.frombuffer(nc).reshape(len(n), -1), itself)
                rows = [(x, n[b], d[b], s) for x, (b, s) in zip(o, found) if b >= 0]
                yield pa.RecordBatch.from_arrays([pa.array(col, ty) for col, ty in zip(zip(*rows) if rows else [()] * 4, (*types, pa.float64()))], ["name", "target", "ord", "similarity"])

    return pairs.mapInArrow(search, f"name {name}, target {target}, ord {order}, similarity double")


def _best(met: DataFrame) -> DataFrame:
    best = met.groupBy("name").agg(F.max(F.struct("similarity", (-F.col("ord")).alias("minus"), "target")).alias("b"))
    return best.select("name", "b.target", (-F.col("b.minus")).alias("ord"), "b.similarity")


def bounds(dots: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """No vector of a lot has a larger product with a candidate: along the lot's direction the candidate's share (``dots``, for each lot)
    times a share between low and high, and across it, by Cauchy-Schwarz, what is left of both."""
    across = np.sqrt(np.maximum(norms[:, None] ** 2 - dots**2, 0)) * rest
    return np.maximum(dots * low, dots * high) + across


def best_target(candidates: DataFrame, targets: DataFrame, weights: dict[str, float], key: str, target: str, ord: str, itself: bool = True) -> DataFrame:
    """key, target, similarity: for each candidate the target with the highest score, the first of equals.

    The score is the weighted sum of the cosines of the columns named in ``weights``, arrays that both have;
    scores within EQUAL of each other count as equal. Vectors are computed once and stored. Targets with equal vectors
    count once (twice if ``itself`` is false, which leaves out the target of the candidate's own name) and lie in lots by the
    nearest of LOTS directions at most, a sample of them. A candidate meets the lot of its nearest direction, then, in packs, the lots
    whose bound its best score so far doesn't exceed, so the result is exact. Targets with a null, a null component or one that is not finite take no
    part; a candidate with such a vector, or with no target, gets nulls.
    """
    fine = F.lit(True)
    for c in weights:
        fine &= F.col(c).isNotNull() & F.forall(c, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    usable = lambda df, id, order: df.select(F.col(id).alias("name"), order.alias("ord"), *weights).where(fine & F.col("name").isNotNull())
    c = stored(usable(candidates, key, F.lit(0)), "candidates")
    t = stored(usable(targets, target, F.col(ord)), "targets")
    widest = [F.max(F.size(w)).alias(w) for w in weights]
    size = [df.agg(F.count(F.lit(1)).alias("n"), *widest).first() for df in (c, t)]
    widths = {w: max(x[w] or 0 for x in size) for w in weights}
    own, known = _vectors(c, weights, widths), _vectors(t, weights, widths)

    # Copies of a vector: the first, and the next one if the first may be the candidate itself.
    first = known.groupBy("cells").agg(F.min(F.struct("ord", "name")).alias("f"))
    once = first.select("f.name", "f.ord", "cells")
    if not itself:
        more = known.join(first.withColumnRenamed("cells", "same"), F.col("cells") == F.col("same")).where(F.struct("ord", "name") > F.col("f"))
        once = once.unionByName(more.groupBy("cells").agg(F.min(F.struct("ord", "name")).alias("f")).select("f.name", "f.ord", "cells"))

    count = max(1, min(LOTS, -(-size[1]["n"] // LOT), CELLS // max(1, sum(widths.values()))))
    if count == 1:
        lots = _packed(once.withColumn("lot", F.lit(0)), LOT)
        return _named(_best(_met(_packed(own.withColumn("lot", F.lit(0)), CANDIDATES), lots, itself)), candidates, key)
    centres = _matrix(once.orderBy(F.xxhash64("cells"), "name").limit(count).select("cells").toArrow()["cells"].combine_chunks())
    centres = centres / np.maximum(np.sqrt((centres**2).sum(1)), np.finfo(float).tiny)[:, None]
    share = known.sparkSession.sparkContext.broadcast(centres)  # CELLS numbers at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lot of the nearest direction, and the vector's share along it and across."""
        for batch in batches:
            m = _matrix(batch.column("cells"))
            dots = m @ share.value.T if len(m) else np.zeros((0, count))
            lot = dots.argmax(1) if len(m) else np.zeros(0, int)
            along = dots[np.arange(len(m)), lot]
            across = np.sqrt(np.maximum((m * m).sum(1) - along**2, 0))
            yield pa.RecordBatch.from_arrays([pa.array(lot, pa.int32()), *batch.columns, pa.array(along), pa.array(across)], ["lot", *batch.schema.names, "along", "across"])

    dealt = lambda df: stored(df.mapInArrow(deal, f"lot int, name {dict(df.dtypes)['name']}, ord {dict(df.dtypes)['ord']}, cells binary, along double, across double"), "dealt")
    held, sent = dealt(once), dealt(own)
    lots = stored(_packed(held.drop("along", "across"), LOT), "lots")
    met = stored(_best(_met(_packed(sent.drop("along", "across"), CANDIDATES), lots, itself)), "met")
    edges = held.groupBy("lot").agg(F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("rest")).orderBy("lot").toArrow()  # LOTS rows at most
    more = _met(_elsewhere(sent, met, centres, edges), lots, itself)
    return _named(_best(met.unionByName(more)), candidates, key)


def _named(best: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """A row for each candidate."""
    return candidates.select(key).where(F.col(key).isNotNull()).distinct().join(best.select(F.col("name").alias(key), "target", "similarity"), key, "left")


def _elsewhere(sent: DataFrame, met: DataFrame, centres: np.ndarray, edges: pa.Table) -> DataFrame:
    """lot, names, cells: the candidates, in packs, for each lot, but their first, that may hold a target as good as the one they have."""
    names = dict(sent.dtypes)["name"]
    lot, low, high, rest = (edges[c].to_numpy() for c in ("lot", "low", "high", "rest"))
    share = sent.sparkSession.sparkContext.broadcast(centres)
    best = sent.join(met.select("name", "similarity"), "name", "left").select("lot", "name", "cells", F.coalesce("similarity", F.lit(float("-inf"))).alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CANDIDATES):
                batch = whole.slice(at, CANDIDATES)
                m = _matrix(batch.column("cells"))
                limit = bounds(m @ share.value[lot].T, np.sqrt((m * m).sum(1)), low, high, rest)
                go = (limit >= batch.column("best").to_numpy()[:, None] - EQUAL) & (lot[None, :] != batch.column("lot").to_numpy()[:, None])
                for k in np.flatnonzero(go.any(0)):
                    some = np.flatnonzero(go[:, k])
                    own = batch.column("name").take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.array([lot[k]], pa.int32()), pa.array([own.to_pylist()], pa.list_(own.type)), pa.array([m[some].tobytes()], pa.binary())], ["lot", "names", "cells"])

    return best.mapInArrow(run, f"lot int, names array<{names}>, cells binary")


def look_alikes(candidates: DataFrame, official: DataFrame, threshold: float | None = None, embed: Callable[[Column], Column] = hashed_embedding, itself: bool = True) -> tuple[DataFrame, DataFrame]:
    """(matches, statistics) of a column domain against official (company, domain, position).

    A candidate within reach of some target is compared with all of them: 0.7 of the similarity of the keys
    and 0.3 of that of the full names. Its best target counts if the similarity exceeds the threshold, by
    default one that depends on the length of the target's key. Unless ``itself``, an official name is not its own target.
    """
    targets = stored(official_targets(official), "official")
    names = candidates.select(F.lower(F.trim("domain")).alias("domain")).where("domain <> ''")
    near = within_reach(names.distinct(), targets, itself=itself)
    vectors = lambda df, c: df.withColumns({"full": embed(F.col(c)), "key": embed(key_domain(F.col(c)))})
    best = best_target(vectors(near, "domain"), vectors(targets.select("target", "ord"), "target"), {"key": 0.7, "full": 0.3}, "domain", "target", "ord", itself)
    hits = best.where(F.col("similarity") > similarity_bound(key_domain(F.col("target")), threshold))
    found = hits.join(targets.select("target", "company"), "target").select("domain", "target", "company", similarity_text(F.col("similarity")).alias("similarity"), F.lit(MATCH_TYPE).alias("match_type"))
    matches = stored(found, "matches")
    total = candidates.agg(F.count("domain").alias("total"))
    stats = total.join(matches.agg(F.count(F.lit(1)).alias("phishing"))).select("total", "phishing", (F.col("total") - F.col("phishing")).alias("benign"), F.when(F.col("total") == 0, 0.0).otherwise(100.0 * F.col("phishing") / F.col("total")).alias("phishing_rate"))
    return matches, stats
