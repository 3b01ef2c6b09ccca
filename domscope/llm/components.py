"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v, root: for each node of an edge the smallest node of its component. Labels and edges are tables of
    their own, so Spark can split the joins at nodes with very many edges; minima are taken before shuffles."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = written(both.unionByName(both.selectExpr("v AS u", "u AS v")).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "v"), "labels")
    held = labels
    while True:
        near = both.join(labels, "v").groupBy("u").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["v"] == near["u"]).select("v", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        lower = written(lower, "lowered")
        up = lower.select(F.col("v").alias("root"), F.col("root").alias("top"))
        new = written(lower.join(up, "root").select("v", F.col("top").alias("root"), (F.col("top") != F.col("old")).alias("moved")), "labels")
        forget(lower, held)
        held, labels = new, new.select("v", "root")
        if new.where("moved").isEmpty():
            forget(both)
            return labels
