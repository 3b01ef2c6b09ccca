"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the sets of its words, its pairs of neighbouring words, and its pairs of
words with one word between them, each hashed into 2**BITS slots; a feature counts once however often
it occurs. Learning goes a few times through four fifths of a bounded, hash-ordered sample of labelled
documents, with a rate per coordinate and an L1 penalty that leaves most weights at zero; slots that
fewer than LEAST_DOCS of these documents have take no part. On the other fifth the bias is moved so that
a score of 0.7 is the cut with the best F1. The weights that are not zero are few, at most 2**BITS,
and are broadcast.

Null and empty texts have no features; their score is that of the bias alone. Very long texts are used whole; in learning
they only make the bounded sample smaller. Labels that are null teach nothing; of several labels for one id the largest
counts, and a labelled id that repeats in the documents teaches each of its rows that is in the sample. Ties in the
order of learning are settled by label and features, so results don't depend on partitions. Without any labelled
document of both kinds all scores are alike: with only one kind that of the bias, without labels 0. An empty table of
documents gives an empty result. Of the columns to keep, one that has the name of the score is left out.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, fresh, lean, written
from .words import words_of

BITS = 20
#: At most about so many labelled documents are learnt from; which ones, a hash of the id decides.
SAMPLE = 18_000
#: And at most about so many bytes of features (4 for each slot of each document), whatever the texts' lengths and however
#: often an id repeats; beyond that, a hash of the rows thins them out.
SAMPLE_BYTES = 96_000_000
LEAST_DOCS = 4
ROWS = 256
_UNI, _BI, _SKIP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHIFT = np.uint64(64 - BITS)
_MASK = np.uint64((1 << BITS) - 1)


def features_of(words: list[bytes]) -> np.ndarray:
    """The slots of a document's words, pairs and skip-pairs, with repetitions."""
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) * _UNI
    mixed = h ^ (h >> np.uint64(29))
    pairs = mixed[:-1] * _BI + mixed[1:]
    skips = mixed[:-2] * _SKIP + mixed[2:]
    return np.concatenate([h >> _SHIFT, (pairs * _UNI) >> _SHIFT, (skips * _BI) >> _SHIFT]).astype(np.int64)


class Ftrl:
    """FTRL-proximal with a rate for each coordinate; the bias has no penalty."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - label
        before = self.n[at]
        after = before + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(before)) / self.alpha * w
        self.n[at] = after
        m = self.bias_n + g * g
        self.bias_z += g - (m**0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n = m


def best_cut(scored: list[tuple[float, int]]) -> float:
    """How far above log(0.7 / 0.3) the cut with the best F1 lies, in the middle of the best ones; 0 without
    examples of both kinds."""
    total = np.array([x for x, _ in scored])
    label = np.array([y for _, y in scored])
    if not label.any() or label.all():
        return 0.0
    order = np.argsort(-total, kind="stable")
    right = np.cumsum(label[order])
    f = 2 * right / (np.arange(1, len(order) + 1) + label.sum())
    best = np.flatnonzero(f >= f.max() - 1e-12)
    k = best[len(best) // 2]
    below = total[order[min(k + 1, len(order) - 1)]]
    return float((total[order[k]] + below) / 2 - np.log(0.7 / 0.3))


def sample_labels(labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """id and label of about ``most`` labelled ids at most, in no order, chosen by a hash of the id."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    total = one.count()
    share = 1.0 if total <= most else 0.97 * most / total
    return one.where((F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))) if share < 1 else F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, rounds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights, and the bias. One task learns, from the sample that ``most`` and
    ``most_bytes`` bound, in one flat array; other tasks make the features."""
    chosen = sample_labels(labels, most, id_col, label_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "label", F.xxhash64("id", F.lit("order")).alias("place"))

    def features(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [np.unique(features_of(w)).astype(np.int32).tobytes() for w in words_of(part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), part.column(1), part.column(2)], ["slots", "label", "place"])

    made = written(rows.mapInArrow(lean(features), "slots binary, label int, place long"), "features")
    n, size = made.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("slots")), F.lit(0))).first()
    share = min(1.0, most / max(1, n), most_bytes / max(1, size))
    if share < 1:
        spread = F.pmod(F.xxhash64("place", F.monotonically_increasing_id()), F.lit(1_000_000))
        made = made.where(spread < F.lit(int(0.97 * share * 1_000_000)))

    def train(batches: Batches) -> Batches:
        flat, ends, marks = np.zeros(1 << 20, np.int32), [0], []
        for b in batches:
            for slots, label in zip(b.column(0), b.column(1).to_pylist()):
                at = np.frombuffer(slots.as_buffer(), np.int32)
                if ends[-1] + len(at) > len(flat):
                    flat.resize(max(2 * len(flat), ends[-1] + len(at)), refcheck=False)
                flat[ends[-1] : ends[-1] + len(at)] = at
                ends.append(ends[-1] + len(at))
                marks.append(label)
        docs_with = np.zeros(1 << BITS, np.int32)
        for k in range(len(marks)):
            if k % 5:
                docs_with[flat[ends[k] : ends[k + 1]]] += 1
        common = docs_with >= LEAST_DOCS
        upto = 0
        for k in range(len(marks)):  # rare slots go, in place
            at = flat[ends[k] : ends[k + 1]]
            at = at[common[at]]
            flat[upto : upto + len(at)] = at
            ends[k], upto = upto, upto + len(at)
        ends[-1] = upto
        model = Ftrl()
        for _ in range(rounds):
            for k, label in enumerate(marks):
                if k % 5:
                    model.learn(flat[ends[k] : ends[k + 1]], label)
        w = model.weights(slice(None))
        kept = np.flatnonzero(w)
        bias = model.bias if marks else -35.0
        bias -= best_cut([(w[flat[ends[k] : ends[k + 1]]].sum() + bias, marks[k]) for k in range(0, len(marks), 5)])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(w[kept], bias))], ["slot", "weight"])

    ordered = made.repartition(1).sortWithinPartitions("place", "label", "slots").select("slots", "label")
    out = written(ordered.mapInArrow(lean(train), "slot long, weight double"), "weights").collect()  # at most 2**BITS rows
    weights = sorted((r.slot, r.weight) for r in out if r.slot >= 0)
    bias = next((r.weight for r in out if r.slot < 0), -35.0)
    return np.array([s for s, _ in weights], np.int64), np.array([w for _, w in weights]), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", keep: list[str] | None = None, as_col: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id by default) and ``as_col`` double, one row per row. Other columns are
    left out, and so is one of ``keep`` that is named ``as_col``, so no name clashes."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c != as_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights
    names = [*keep, as_col]

    def run(batches: Batches) -> Batches:
        slots, weights, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[slots] = weights
        used = dense != 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = []
                for k, words in enumerate(words_of(batch.column(len(keep)))):
                    f = features_of(words)
                    found.append(f[used[f]] + (k << BITS))
                pairs = np.unique(np.concatenate(found))
                total = np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], batch.num_rows) + bias
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names)

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(as_col, T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(fresh(keep, "__text"))).mapInArrow(lean(run), schema)
