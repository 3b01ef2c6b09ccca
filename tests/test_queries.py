import pytest
from pyspark.sql import functions as F

from domscope.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_a_result_book_longer_than_a_sheet_equals_sql(spark, tmp_path):
    import duckdb

    from domscope.sources.xlsx import MOST_ROWS

    spark.range(MOST_ROWS + 5).selectExpr("id AS p_partkey", "concat('n', id % 64, ' ') AS p_name", "CAST(id % 50 + 1 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(f"SELECT sheet, count(*), count(DISTINCT domain), sum(CAST(size AS BIGINT)) FROM ({ORACLE_SQL['result_book']}) GROUP BY sheet").fetchall()
    got = QUERIES["result_book"](spark, str(tmp_path)).groupBy("sheet").agg(F.count("*"), F.count_distinct("domain"), F.sum(F.col("size").cast("long"))).collect()
    assert {tuple(r) for r in got} == set(want) and len(want) == len(got) == 3


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_stay_in_the_jvm(spark):
    for name in ("actor_match_top5", "lexical_features", "entity_attribute_counts", "polymorphic_join"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["events_total"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "ReadSchema: struct<event_type:string>" in plan


def test_all_vectors_and_hosts_have_a_row(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert QUERIES["lookalike_match"](spark, DATA).where("target IS NOT NULL").select("vec_id").distinct().count() == e.select("vec_id").distinct().count()
    assert QUERIES["lookalike_hosts"](spark, DATA).first().total == QUERIES["host_normalise"](spark, DATA).where("host <> ''").select("host").distinct().count()


def test_hosts_of_odd_pages_count(spark, tmp_path):
    pages = [(1, "https://secure-login.alpha.com/x"), (2, "https://news.beta.org/"), (3, "https://secure-l0gin.alpha.com/"), (4, "https://secure-1ogin.alpha.com/"), (21, "https://www.alpha.com/")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    hosts = {u.split("/")[2] for _, u in pages}
    best = {r.domain: r for r in QUERIES["actor_match_top5"](spark, str(tmp_path)).where("rank = 1").collect()}
    assert set(best) == hosts and best["secure-login.alpha.com"].organization_id == 1 and best["www.alpha.com"].organization_id == 1 and best["secure-l0gin.alpha.com"].organization_id == 3
    groups = {r.organization: r.domains for r in QUERIES["org_grouped_domains"](spark, str(tmp_path)).collect()}
    assert groups == {1: "secure-login.alpha.com,www.alpha.com", 2: "news.beta.org", 3: "secure-l0gin.alpha.com", 4: "secure-1ogin.alpha.com"}
    alerts = QUERIES["alert_document"](spark, str(tmp_path)).collect()
    assert {r.domain for r in alerts} == hosts and all(r.risk_score >= 0.45 for r in alerts)
    near = {"secure-login.alpha.com", "secure-l0gin.alpha.com", "secure-1ogin.alpha.com"}
    assert {r.domain for r in QUERIES["edit_distance_candidates"](spark, str(tmp_path)).collect()} == near


def test_forest_has_all_trees(spark, monkeypatch):
    from domscope import queries

    seen = []
    train = queries.detection.train
    monkeypatch.setattr(queries.detection, "train", lambda *a, **b: seen.append(train(*a, **b)) or seen[-1])
    assert QUERIES["train_and_score"](spark, DATA).count() == 1 and seen[0].stages[-1].getNumTrees == 100
