"""Documents with similar sets of word n-grams: a Jaccard join by MinHash banding.

1. Each text's set of n-grams is hashed to 64 bits a gram. Texts with equal sets are one class.
2. A class gets a MinHash signature, cut into bands. The number of bands and of rows in each is chosen for
   the recall wanted at the threshold.
3. Classes are shuffled by the hashes of their bands. A hash that several classes share is a bucket; classes without
   one have no links.
4. Classes with buckets are dealt into blocks, in order of their largest bucket, so that similar ones lie side by side. A
   block is bounded in classes and in n-grams. Blocks that have a bucket in common are compared, each pair of blocks once,
   in a task of its own: there the full sets of n-grams of those classes that buckets connect are compared all with all,
   in one step on matrices. Only sums and the smallest member of what is linked leave the task, never the pairs. So
   no link between classes that share a bucket is lost, however many there are in it, and chains of buckets cost nothing
   beyond the buckets themselves.
5. Components of the verified links are the classes of the result.

Words are as in words_of(). A text with words, but fewer than n, has one gram, of all its words. Null texts
and texts without words have none: they are alone, without links. Very long texts are used whole; one with more n-grams
than a block should have is a block of its own. Rows that share an id are taken as documents of their own; a null id comes
before all others as the name of a class. Equal sets of n-grams are one class, whose head is the smallest id, then row. An
empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from hashlib import blake2b
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, forget, lean, written
from .components import components
from .words import words_of

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Classes and n-grams that a block has at most.
BLOCK = 256
BLOCK_GRAMS = 1_000_000
ROWS = 256
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def choose_bands(threshold: float, recall: float, most_hashes: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows for which a pair at the threshold meets in some band with the recall
    and the signature isn't longer than ``most_hashes``."""
    fits = [(b, r) for r in range(1, 17) if (b := max(1, ceil(log(1 - recall) / log(1 - threshold**r)))) * r <= most_hashes]
    if not fits:
        raise ValueError("no banding within so many hashes has this recall")
    return fits[-1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def gram_set(words: list[bytes], n: int = NGRAM) -> np.ndarray:
    """The distinct hashes of a text's n-grams, sorted."""
    from xxhash import xxh3_64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mix(h * _B + w[k : len(words) - n + 1 + k])
    return np.unique(h)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return rng.integers(1, 2**32, count, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 2**32, count, np.uint64).astype(np.uint32)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Of (row, id, text): row, id, digest of the set, grams (its size), bands array<long>; null digest without grams."""
    a, b = _permutations(bands * rows)
    a, b = a[:, None], b[:, None]

    def run(batches: Batches) -> Batches:
        salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                digests, sizes, hashes = [], [], []
                for words in words_of(batch.column(2)):
                    grams = gram_set(words, n)
                    sizes.append(len(grams))
                    if not len(grams):
                        digests.append(None)
                        hashes.append([])
                        continue
                    digests.append(blake2b(grams.tobytes(), digest_size=16).digest())
                    x = (grams >> np.uint64(32)).astype(np.uint32)
                    low = np.full(bands * rows, 2**32 - 1, np.uint32)
                    for c in range(0, len(x), 2048):
                        np.minimum(low, (a * x[c : c + 2048] + b).min(1), out=low)
                    h = salt.copy()
                    for r in low.reshape(bands, rows).T.astype(np.uint64):
                        h = _mix(h * _A + r)
                    hashes.append(h.astype(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["row", "id", "digest", "grams", "bands"])

    return docs.select("row", "id", "text").mapInArrow(lean(run), "row long, id long, digest binary, grams long, bands array<bigint>")


def compare(sets: list[np.ndarray], left: int | None, threshold: Fraction) -> np.ndarray:
    """Which pairs reach the threshold, as a symmetric matrix. With ``left`` only pairs of one of the first
    so many with one of the others."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, slot, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # the others are in no intersection
    number = np.cumsum(shared) - 1
    pick = shared[slot]
    slot, owner = number[slot[pick]], owner[pick]
    order = np.argsort(slot, kind="stable")
    slot, owner = slot[order], owner[order]
    both = np.zeros((n, n), np.float64)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(slot, [at, at + width])
        m = np.zeros((n, min(width, int(shared.sum()) - at)), np.float32)
        m[owner[a:b], slot[a:b] - at] = 1
        both += m @ m.T
    inter = both.astype(np.int64)
    linked = inter * threshold.denominator >= threshold.numerator * (sizes[:, None] + sizes[None, :] - inter)
    np.fill_diagonal(linked, False)
    if left is not None:
        linked[:left, :left] = False
        linked[left:, left:] = False
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each index the smallest one in its component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _connected(bands: list[list[int]]) -> list[np.ndarray]:
    """The members, in order, of each component of two or more that equal band hashes make of these classes."""
    owner = np.repeat(np.arange(len(bands)), [len(x) for x in bands])
    _, bucket = np.unique(np.concatenate([np.array(x, np.int64) for x in bands]), return_inverse=True)
    label = np.arange(len(bands))
    while True:
        least = np.full(bucket.max() + 1, len(bands))
        np.minimum.at(least, bucket, label[owner])
        new = label.copy()
        np.minimum.at(new, owner, least[bucket])
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
    return [p for p in parts if len(p) > 1]


def blocks_of(active: DataFrame, most: int, most_grams: int) -> DataFrame:
    """Of (c, grams, place, ...) the rows with a column block, long: neighbours in order of place and c share one."""
    parts = max(1, int(active.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = active.repartitionByRange(parts, "place", "c").sortWithinPartitions("place", "c")
    where = active.columns.index("grams")

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        block, count, grams = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            numbers = []
            for n in batch.column(where).to_pylist():
                if count and (count == most or grams + n > most_grams):
                    block, count, grams = block + 1, 0, 0
                count, grams = count + 1, grams + n
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names)

    schema = active.schema.add("block", "long")
    names = schema.names
    return ordered.mapInArrow(lean(run), schema)


def verified(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """Of (i, j, block, c, copies, bands, text) - pairs of blocks i <= j, each with the classes of both - c, links
    (documents of linked classes) and root (the smallest class linked there)."""
    exact = Fraction(threshold).limit_denominator(10**6)
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = members.select("i", "j", "block", "c", "copies", "bands", "text").repartition(parts, "i", "j").sortWithinPartitions("i", "j", "block", "c")

    def solve(group: list[tuple], i: int, j: int) -> list[tuple[int, int, int]]:
        out = []
        for part in _connected([bands for _, _, _, bands, _ in group]):
            some = [group[k] for k in part]
            left = None if i == j else sum(block == i for block, *_ in some)
            if left is not None and left in (0, len(some)):
                continue
            linked = compare([x for *_, x in some], left, exact)
            if not linked.any():
                continue
            c = np.array([x for _, x, *_ in some])
            copies = np.array([x for _, _, x, *_ in some])
            o = np.argsort(c)
            root = _roots(linked[np.ix_(o, o)])[np.argsort(o)]
            links = linked @ copies
            out += [(int(c[k]), int(links[k]), int(c[o[root[k]]])) for k in np.flatnonzero(linked.any(1))]
        return out

    def run(batches: Batches) -> Batches:
        key, group = None, []
        out: list[tuple[int, int, int]] = []
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                lead = list(zip(*(batch.column(k).to_pylist() for k in range(6))))
                for (i, j, block, c, copies, bands), words in zip(lead, words_of(batch.column(6))):
                    if (i, j) != key:
                        out += solve(group, *key) if len(group) > 1 else []
                        key, group = (i, j), []
                    group.append((block, c, copies, bands, gram_set(words, n)))
                if len(out) > 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["c", "links", "root"])
                    out = []
        out += solve(group, *key) if len(group) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["c", "links", "root"])

    return dealt.mapInArrow(lean(run), "c long, links long, root long")


def similar_documents(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Of (row, id, text), where row tells rows apart: row, id, class_row and class_id (of the document with the
    smallest id, then row, in the class) and n_links, the number of other documents at the threshold, copies
    included."""
    bands, rows = choose_bands(threshold, recall)
    signed = written(signatures(docs, n, bands, rows), "signatures")
    one = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "row")).alias("head"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    classes = written(one.withColumn("c", F.monotonically_increasing_id()), "classes")

    banded = classes.select("c", F.explode("bands").alias("h"))
    buckets = written(banded.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    # A class has one row for each of its bands at most, so what is gathered here is small.
    mine = banded.join(buckets, "h").groupBy("c").agg(F.collect_list("h").alias("bands"), F.max(F.struct("n", "h")).alias("place"))
    active = classes.select("c", "copies", "grams", "head.row").join(mine, "c")
    active = written(blocks_of(active, BLOCK, BLOCK_GRAMS), "blocks")

    # A class goes to its own block, and to another one if it has a bucket there; pairs of blocks meet at the smaller. What is listed
    # are names of blocks, of which a bucket has 1/256 of its classes or few.
    mine = active.select("c", "block", F.explode("bands").alias("h"))
    of_bucket = mine.select("h", "block").distinct().groupBy("h").agg(F.collect_list("block").alias("others")).where("size(others) > 1")
    of_bucket = written(of_bucket, "block-buckets")
    away = mine.join(of_bucket, "h").groupBy("c").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    placed = active.join(away, "c", "left").select("row", "c", "copies", "bands", "block", F.coalesce("others", F.array("block")).alias("others"))
    # A merge join at every size: the texts are shuffled once, and no limit of broadcasts changes that as tables grow.
    texts = docs.select("row", "text").join(written(placed, "placed").hint("merge"), "row").withColumn("other", F.explode("others"))
    found = written(verified(texts.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), n, threshold), "links")

    tops = components(found.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    labelled = classes.select("c", "digest", "copies", "head").join(tops.withColumnRenamed("v", "c"), "c", "left").join(links, "c", "left")
    labelled = written(labelled.withColumn("root", F.coalesce("root", "c")), "labelled")
    best = written(labelled.groupBy("root").agg(F.min("head").alias("best")), "best")
    named = written(labelled.join(best, "root").select("digest", "best", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    forget(classes, buckets, active, of_bucket, found, labelled, best)
    return signed.select("row", "id", "digest").join(named, "digest", "left").select(
        "row", "id", F.coalesce("best.row", "row").alias("class_row"), F.when(F.col("best").isNotNull(), F.col("best.id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def with_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id and text, written, so that rows keep their numbers."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "texts")


def keep_one(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id. All columns stay, but for one named
    __row."""
    rows = written(docs.drop("__row").withColumn("__row", F.monotonically_increasing_id()), "documents")
    slim = rows.select(F.col("__row").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    others = written(similar_documents(slim, n, threshold).where("row <> class_row").select(F.col("row").alias("__row")), "others")
    return rows.join(others, "__row", "left_anti").drop("__row")
