"""A fitted forest as a table of nodes, which scores rows by column expressions: no model object is loaded, and SQL can walk the
same table.

A node has its tree and number (the root is 0), and, unless it is a leaf, a feature, the scaling of that feature (the feature less
shift, times scale), the threshold up to which a row goes to the node ``left``, else to ``right``; also the shares of both classes among the rows that
it was trained with, and ``depth``, the longest way down its tree. Shares of the leaves are added over the trees; a row's
probability is that of class 1 among these, its label 1 if that is more than half.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexical import NAMES
from ..session import scratch
from .detection import BENIGN, MALICIOUS

NODES = "tree int, node int, feature int, shift double, scale double, threshold double, left int, right int, share_0 double, share_1 double, depth int"
#: Nodes that a row may travel with.
MOST_NODES = 1_000_000


def node_table(model: PipelineModel) -> DataFrame:
    """The nodes of a model of detection.train(), from what the model stores of itself."""
    spark = SparkSession.active()
    path = f"{scratch(spark, 'model')}/pipeline"
    model.write().overwrite().save(path)
    assembler, scaler, forest = model.stages
    last = len(model.stages) - 1
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    scales = spark.createDataFrame([(k, float(m), 1 / float(s) if s else 0.0) for k, (m, s) in enumerate(zip(mean, std))], "feature int, shift double, scale double")
    stored = spark.read.parquet(f"{path}/stages/{last}_*/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    leaf, total = F.col("leftChild") < 0, F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    share = lambda k: F.when(total > 0, F.col("impurityStats")[k] / total).otherwise(0.0)
    nodes = stored.select(
        "tree", F.col("id").alias("node"), F.when(~leaf, F.col("split.featureIndex")).alias("feature"), F.when(~leaf, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(~leaf, F.col("leftChild")).alias("left"), F.when(~leaf, F.col("rightChild")).alias("right"), share(0).alias("share_0"), share(1).alias("share_1"), F.lit(forest.getMaxDepth()).alias("depth"),
    )
    names = [x.split()[0] for x in NODES.split(", ")]
    return nodes.join(F.broadcast(scales), "feature", "left").select(names)


def save(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(path)


def _packed(nodes: DataFrame) -> DataFrame:
    """One row: the trees, each with its nodes in order and its depth."""
    n = nodes.count()
    if not 0 < n <= MOST_NODES:
        raise ValueError(f"a forest of {n} nodes, not of 1 to {MOST_NODES}")
    one = F.struct("node", "feature", "shift", "scale", "threshold", "left", "right", "share_0", "share_1")
    trees = nodes.groupBy("tree").agg(F.array_sort(F.collect_list(one)).alias("nodes"), F.max("depth").alias("depth"))
    return trees.agg(F.array_sort(F.collect_list(F.struct("tree", "nodes", "depth"))).alias("__forest"))


def _leaf(tree: Column, values: Column) -> Column:
    """The leaf of a tree that a row comes to."""

    def step(at: Column, _: Column) -> Column:
        node = tree["nodes"][at]
        x = (values[node["feature"]] - node["shift"]) * node["scale"]
        return F.when(node["feature"].isNull(), at).when(x <= node["threshold"], node["left"]).otherwise(node["right"])

    return tree["nodes"][F.aggregate(F.sequence(F.lit(1), F.greatest(tree["depth"], F.lit(1))), F.lit(0), step)]


def score(nodes: DataFrame, df: DataFrame, threshold: float | None = None, columns: tuple[str, ...] = NAMES) -> DataFrame:
    """``df`` with predicted, label_text and probability, as detection.predict() gives them. A null feature is like NaN: it goes right."""
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    held = df.withColumn("__values", values).join(F.broadcast(_packed(nodes)))
    leaves = F.transform("__forest", lambda t: _leaf(t, F.col("__values")))
    votes = F.aggregate(leaves, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, leaf: F.struct((s["a"] + leaf["share_0"]).alias("a"), (s["b"] + leaf["share_1"]).alias("b")))
    voted = held.select(*df.columns, votes.alias("__votes"))
    chance = F.col("__votes.b") / (F.col("__votes.a") + F.col("__votes.b"))
    label = F.when(chance >= threshold if threshold is not None else F.col("__votes.b") > F.col("__votes.a"), 1).otherwise(0)
    out = voted.withColumns({"__label": label, "__chance": chance})
    return out.select(*df.columns, F.col("__label").alias("predicted"), F.when(F.col("__label") == 1, MALICIOUS).otherwise(BENIGN).alias("label_text"), F.col("__chance").alias("probability"))
