"""Cleaning a corpus in stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last one, which returns
tokens. Between stages the documents are written to the shared folder and read again; what a stage wrote goes when
the next one is written.

Of every stage: null and empty texts pass through all of them, as clean documents of no class, and end with no tokens;
very long texts are worked on whole. Rows that share a doc_id are documents of their own; what a stage decides by id
alone (labels to learn from) holds for each of them. Ties - equal texts, equal sets of word n-grams - are kept once,
by the smallest doc_id, then in no given order. Columns beyond those of documents pass through to the last stage, which
leaves them out; names of columns that the operators use inside don't clash with them. An empty table of documents,
labels or benchmark items is no special case: without labels no document is toxic, without items none is cut.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domscope.llm import bpe
from domscope.llm.common import forget, fresh, table, written
from domscope.llm.decontaminate import decontaminate
from domscope.llm.line_dedup import dedup_lines
from domscope.llm.near_copies import keep_one
from domscope.llm.op8 import WINDOW
from domscope.llm.op9 import THRESHOLD, fold_model
from domscope.llm.op10 import vocabulary
from domscope.llm.toxicity import score


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_further_columns(stage: Stage) -> Stage:
    """``stage``, which gets columns beyond those of documents as one, so that no operator sees their names."""

    @wraps(stage)
    def whole(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in COLUMNS]
        if not more:
            return stage(spark, docs, sf_dir)
        held = docs.select(*COLUMNS, F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(more)]).alias("further_columns"))
        back = {c: F.col(f"further_columns.c{k}").alias(c) for k, c in enumerate(more)}
        return stage(spark, held, sf_dir).select(*[back.get(c, c) for c in docs.columns])

    return whole


@with_further_columns
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the others go."""
    own = fresh(docs.columns, "__toxicity")
    scored = score(docs, fold_model(spark, docs, sf_dir), keep=docs.columns, as_col=own)
    return scored.where(F.col(own) < THRESHOLD).drop(own)


@with_further_columns
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines. Documents of which nothing is left go; those that were
    empty before stay."""
    done = dedup_lines(docs, counts=("__lines", "__removed")).where("__removed = 0 OR trim(text) <> ''")
    counted = F.when(F.col("__removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", counted).drop("__lines", "__removed")


@with_further_columns
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones."""
    return keep_one(docs)


@with_further_columns
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that hardly hold anything else go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), WINDOW)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids, and whether decoding gives the text again."""
    path, pattern = vocabulary()
    done = bpe.encode(docs, path, pattern, keep=["doc_id", "lang", "source", "n_chars", "text"], decoded=True)
    exact = F.col("decoded_bytes") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return done.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: The first stage is a learnt model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents to tokens."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
