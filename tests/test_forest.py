import duckdb
import pytest
from pyspark.sql import functions as F

from domscope.functions.lexical import NAMES
from domscope.operators import detection, forest
from tests.conftest import DATA

#: Walks the stored nodes from the roots down, for every row.
WALK = """
WITH RECURSIVE n AS (FROM read_parquet('{nodes}/*.parquet')), v AS (FROM read_parquet('{rows}/*.parquet')),
w AS (
  SELECT host, f, tree, 0 AS node FROM v CROSS JOIN (SELECT DISTINCT tree FROM n)
  UNION ALL
  SELECT host, f, w.tree, CASE WHEN (f[feature + 1] - shift) * scale <= threshold THEN "left" ELSE "right" END FROM w JOIN n ON n.tree = w.tree AND n.node = w.node WHERE feature IS NOT NULL)
SELECT host, sum(share_1) / (sum(share_0) + sum(share_1)) FROM w JOIN n ON n.tree = w.tree AND n.node = w.node WHERE feature IS NULL GROUP BY host
"""


@pytest.fixture(scope="module")
def fitted(spark):
    from domscope.queries import _hosts, _labelled

    model = detection.train(_labelled(spark, DATA), trees=30)
    hosts = detection.with_features(_hosts(spark, DATA), "host").cache()
    return model, forest.node_table(model).cache(), hosts


@pytest.mark.parametrize("threshold", [None, 0.5, 0.25])
def test_scores_equal_the_model(spark, fitted, threshold):
    model, nodes, hosts = fitted
    rows = lambda df: sorted((r.host, r.predicted, r.label_text, r.probability) for r in df.collect())
    want = rows(detection.predict(model, hosts, threshold))
    assert rows(forest.score(nodes, hosts, threshold)) == want and len({x[3] for x in want}) > 3


def test_scores_equal_recursive_sql(spark, fitted, tmp_path):
    _, nodes, hosts = fitted
    forest.save(nodes, f"{tmp_path}/nodes")
    hosts.select("host", F.array(*NAMES).alias("f")).write.parquet(f"{tmp_path}/rows")
    walked = dict(duckdb.sql(WALK.format(nodes=f"{tmp_path}/nodes", rows=f"{tmp_path}/rows")).fetchall())
    again = forest.load(spark, f"{tmp_path}/nodes")
    got = {r.host: r for r in forest.score(again, hosts, 0.4).collect()}
    assert set(got) == set(walked) and len(got) == hosts.count()
    for host, chance in walked.items():
        assert abs(got[host].probability - chance) < 1e-12 and got[host].predicted == int(got[host].probability >= 0.4)


def test_scoring_needs_no_python_and_no_model(spark, fitted):
    plan = forest.score(fitted[1], fitted[2])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDF" not in plan and "CartesianProduct" not in plan


def test_edges(spark, fitted):
    model, nodes, hosts = fitted
    odd = hosts.limit(3).withColumns({c: F.lit(None).cast("double") for c in NAMES[:6]}).withColumn("entropy", F.lit(float("nan")))
    rows = lambda df: sorted((r.host, r.predicted, r.probability) for r in df.collect())
    assert rows(forest.score(nodes, odd)) == rows(detection.predict(model, odd))
    assert forest.score(nodes, hosts.limit(0)).count() == 0
    with pytest.raises(ValueError):
        forest.score(nodes.limit(0), hosts)
    stump = spark.createDataFrame([(0, 0, None, None, None, None, None, None, 0.5, 0.5, 0)], forest.NODES)
    assert {(r.predicted, r.probability) for r in forest.score(stump, hosts).collect()} == {(0, 0.5)}
