"""Classification of domains: features, training, scores, statistics, alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import percent_text
from ..functions.lexical import NAMES, features, segments
from ..plans.relational import first_by_key, numbered

# What labels are called.
MALICIOUS, BENIGN = "恶意", "正常"


def with_features(df: DataFrame, domain: str = "domain", segment: Callable[[Column], Column] | None = None) -> DataFrame:
    """``df`` with the lexical features of the domain; ``segment`` finds the words of long parts, once a row."""
    if segment is None:
        return df.select("*", *features(F.col(domain)))
    cut = df.withColumn("__words", segments(F.col(domain), segment))
    return cut.select(*df.columns, *features(F.col(domain), F.col("__words")))


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): the test part has the rest of the share, rounded up, and each label its part of both, what
    remains going to the labels with the largest remainders, then to the smaller label. Which rows is settled by a hash
    of the key, the same every time; no task holds a whole label."""
    counts = df.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    everything = Window.partitionBy()  # of the counts: a row a label
    total = F.sum("__n").over(everything)
    fit = (total - F.ceil(F.round(total * (1 - share), 6))).cast("long")
    quota = counts.withColumns({"__fit": fit, "__exact": F.col("__n") * fit / total}).withColumn("__take", F.floor("__exact"))
    order = Window.orderBy(F.desc(F.round(F.col("__exact") - F.col("__take"), 9)), F.col("__l"))
    left = F.col("__fit") - F.sum("__take").over(everything)
    quota = quota.withColumn("__take", F.col("__take") + (F.row_number().over(order) <= left).cast("long")).select("__l", "__take")
    hashed = df.withColumn("__key", F.xxhash64(F.col(key), F.lit(seed)))
    placed = numbered(hashed, "__key", "__at", [label]).join(quota, F.col(label).eqNullSafe(F.col("__l")))
    part = lambda test: placed.where(test).select(*df.columns)
    return part(F.col("__at") <= F.col("__take")), part(F.col("__at") > F.col("__take"))


def train(df: DataFrame, label: str = "label", columns: tuple[str, ...] = NAMES, kind: str = "forest", trees: int = 100, seed: int = 42) -> PipelineModel:
    """A scaled forest or linear SVM. The scaler divides by the sample deviation, which differs from the
    population's by one factor for all columns, and so in no decision of either model's training."""
    last = (
        RandomForestClassifier(labelCol=label, featuresCol="scaled", numTrees=trees, seed=seed)
        if kind == "forest"
        else LinearSVC(labelCol=label, featuresCol="scaled")
    )
    stages = [VectorAssembler(inputCols=list(columns), outputCol="vector", handleInvalid="keep"), StandardScaler(inputCol="vector", outputCol="scaled", withMean=True), last]
    return Pipeline(stages=stages).fit(df)


def predict(model: PipelineModel, df: DataFrame, threshold: float | None = None) -> DataFrame:
    """``df`` with label, label_text and probability. With a threshold the label is 1 from that probability on;
    models without probabilities give 1 or 0 for it, and their own label."""
    out = model.transform(df)
    own = F.col("prediction").cast("int")
    chance = vector_to_array("probability")[1] if "probability" in out.columns else own.cast("double")
    label = F.when(chance >= threshold, 1).otherwise(0) if threshold is not None and "probability" in out.columns else own
    return out.withColumns({"__label": label, "__chance": chance}).select(*df.columns, F.col("__label").alias("predicted"), F.when(F.col("__label") == 1, MALICIOUS).otherwise(BENIGN).alias("label_text"), F.col("__chance").alias("probability"))


def statistics(df: DataFrame, positive: Column) -> DataFrame:
    """One row: total, malicious, benign, and the malicious rate in percent, as number and text."""
    n, k = F.count(F.lit(1)), F.count(F.when(positive, 1))
    return df.agg(n.alias("total"), k.alias("malicious")).select(
        "total", "malicious", (F.col("total") - F.col("malicious")).alias("benign"), F.when(F.col("total") == 0, 0.0).otherwise(100.0 * F.col("malicious") / F.col("total")).alias("rate"), percent_text(F.col("malicious"), F.col("total")).alias("rate_text")
    )


def malicious_only(df: DataFrame, label: str = "predicted") -> DataFrame:
    return df.where(F.col(label) == 1)


def alert_rows(df: DataFrame, threshold_percent: float, domain: str = "domain", label: str = "predicted", probability: str = "probability", position: str = "position") -> DataFrame:
    """Malicious rows above - not at - the threshold, one for each name whatever its case: the first."""
    rows = df.where((F.col(label) == 1) & (F.col(probability) > threshold_percent / 100)).withColumn("__key", F.lower(F.trim(domain)))
    return first_by_key(rows.where("__key <> ''"), ["__key"], [F.col(position)]).drop("__key")


def look_alike_alert_rows(matches: DataFrame, stats: DataFrame, domain: str = "domain") -> DataFrame:
    """The distinct names of look-alikes, for an alert; none if the statistics, a row, count no phishing."""
    some = stats.where("phishing > 0").select(F.lit(True).alias("__some"))
    return matches.where(F.col(domain).isNotNull()).select(domain).distinct().join(F.broadcast(some)).drop("__some")


def metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: accuracy, precision, recall, f1; 0 where a denominator is."""
    cell = lambda y, p: F.count(F.when((F.col(label) == y) & (F.col(predicted) == p), 1)).cast("double")
    c = df.agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1.0).otherwise(b))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
