"""Files written by ranges, and rows that a database gets exactly once."""

import pytest
from pyspark.sql import functions as F

from domscope.operators import attribution
from domscope.sources import jdbc
from domscope.sources.stitched import write_stitched

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def alert_parts(spark, n):
    """An alert and items, some of whose fields are null or need escapes."""
    hosts = spark.range(n).select(F.concat(F.lit('d"é-'), "id", F.lit(".com")).alias("domain"), F.pmod(F.xxhash64("id"), F.lit(max(1, n // 2))).alias("position"))
    profs = spark.createDataFrame([(1, "Team é", ["a"], ["d-1.com"], ["d"], ["com"], "v")], "organization_id int, name string, alias array<string>, previous_domains array<string>, keywords array<string>, common_tlds array<string>, version string")
    found = attribution.best_matches(attribution.candidates(hosts.where("position % 3 > 0"), profs))
    items = attribution.alert_items(hosts, found)
    return spark.createDataFrame([("a1", "s\n1", None)], "alert_id string, subscription_id string, detected_count long"), items


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_alert_file_equals_the_document(spark, tmp_path, n):
    alert, items = alert_parts(spark, n)
    path = f"{tmp_path}/x/full_result.json"
    attribution.write_alert(alert, items, path)
    with open(path, encoding="utf-8", newline="") as f:
        assert f.read() == attribution.alert_document(alert, items).first().document + "\n"
    attribution.write_alert(alert, items.limit(0), path)  # in place of the first
    assert spark.read.json(path, multiLine=True).first().summary.high_risk_count == 0


def test_long_alert_is_written_by_ranges(spark, tmp_path):
    n = 200_000
    null = lambda kind: F.lit(None).cast(kind)
    evidence = "struct<best_ioc: string, keyword_overlap: array<string>, tld_hit: boolean, label_hit: boolean, ioc_score: double, keyword_score: double, pattern_score: double>"
    items = spark.range(n).select(F.col("id").alias("position"), F.concat(F.lit("d"), "id").alias("domain"), (F.col("id") % 100 / 100.0).alias("risk_score"), F.lit("low").alias("risk_level"), null("double").alias("organization_score"), null("array<struct<organization_id: int, name: string>>").alias("matched_organizations"), F.array(F.lit("x")).alias("evidence_lines"), null(evidence).alias("evidence"), null("array<struct<rank: int>>").alias("top_candidates"))
    path = f"{tmp_path}/big.json"
    attribution.write_alert(spark.createDataFrame([("a",)], "alert_id string"), items, path)
    read = spark.read.schema("summary struct<high_risk_count: long>, high_risk_domains array<struct<domain: string>>").json(path, multiLine=True)
    got = read.select("summary.high_risk_count", F.size("high_risk_domains").alias("n"), F.expr("high_risk_domains[0].domain").alias("a"), F.expr(f"high_risk_domains[{n - 1}].domain").alias("z")).first()
    assert tuple(got) == (n, n, "d0", f"d{n - 1}")


@pytest.mark.parametrize("n", [0, 1, 500])
def test_notice_file_equals_the_text(spark, tmp_path, n):
    names = F.element_at(F.array(*[F.lit(x) for x in ("Zeta", "alpha", " ", "Älpha")]), F.when(F.col("id") % 7 == 0, 3).when(F.col("id") % 2 == 0, 1).when(F.col("id") % 3 == 0, 4).otherwise(2))
    m = spark.range(n).select(F.concat(F.when(F.col("id") % 5 == 0, "D").otherwise("d"), F.col("id") % 400).alias("domain"), names.alias("organization_name"))
    attribution.write_notice(m, f"{tmp_path}/notice.txt")
    with open(f"{tmp_path}/notice.txt", encoding="utf-8") as f:
        assert f.read() == attribution.notice_text(attribution.by_organization(m)).first().text + "\n"


def test_a_failed_file_leaves_the_old_one(spark, tmp_path):
    good = spark.createDataFrame([(1, "a")], "at int, line string")
    write_stitched(good, ["at"], f"{tmp_path}/f.txt")
    with pytest.raises(Exception):
        write_stitched(good.withColumn("line", F.raise_error(F.lit("no"))), ["at"], f"{tmp_path}/f.txt")
    assert (tmp_path / "f.txt").read_text() == "a\n"


# Exactly once ------------------------------------------------------------------------------------------------


def rows_of(spark, url, table):
    return sorted(tuple(r) for r in jdbc.jdbc_table(spark, url, table, driver=DRIVER).collect())


def test_a_batch_counts_once(spark):
    url = "jdbc:derby:memory:once;create=true"
    df = spark.range(300).repartition(4).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), "id")).alias("v")).unionByName(spark.createDataFrame([(5, "v5"), (5, "v5")], "id long, v string"))
    want = sorted((r.id, r.v) for r in df.collect())
    got = lambda: sorted((r[0], r[1]) for r in jdbc.jdbc_table(spark, url, "things", driver=DRIVER).collect())
    key = lambda rows: sorted(rows, key=str)
    assert jdbc.write_once(df, url, "things", "b1", driver=DRIVER) and not jdbc.write_once(df, url, "things", "b1", driver=DRIVER)
    assert key(got()) == key(want) and jdbc.jdbc_table(spark, url, "things_stage", driver=DRIVER).count() == 0
    assert jdbc.write_once(df.limit(3), url, "things", "b2", driver=DRIVER) and len(got()) == len(want) + 3
    with pytest.raises(ValueError):
        jdbc.write_once(df.withColumn("staged_row", F.lit(1)), url, "things", "b3", driver=DRIVER)


def test_tasks_that_run_again_leave_no_double_row(spark, monkeypatch):
    """The stage gets some tasks' rows twice, as if their executors were lost after the commit, and a job dies midway."""
    url = "jdbc:derby:memory:again;create=true"
    df = spark.range(200).repartition(5).selectExpr("id", "concat('v', id) AS v")
    write = jdbc.write_jdbc

    def twice(rows, url, table, **options):
        write(rows, url, table, **options)
        if table.endswith("_stage"):
            write(rows.where("staged_row % 3 = 0"), url, table, **options)

    def dies(rows, url, table, **options):
        write(rows.where("staged_row % 2 = 0"), url, table, **options)
        if table.endswith("_stage") and not rows.isEmpty():
            raise RuntimeError("killed")

    monkeypatch.setattr(jdbc, "write_jdbc", dies)
    with pytest.raises(RuntimeError):
        jdbc.write_once(df, url, "things", "b", driver=DRIVER)
    monkeypatch.setattr(jdbc, "write_jdbc", twice)
    assert jdbc.write_once(df, url, "things", "b", driver=DRIVER)
    monkeypatch.setattr(jdbc, "write_jdbc", write)
    assert rows_of(spark, url, "things") == sorted((k, f"v{k}") for k in range(200))


def test_a_transaction_that_fails_leaves_the_table(spark, monkeypatch):
    url = "jdbc:derby:memory:fails;create=true"
    df = spark.range(10).selectExpr("id")
    jdbc.write_once(df, url, "things", "a", driver=DRIVER)
    run = jdbc._Statements.__call__

    def fail(self, sql, *values):
        if sql.startswith("INSERT INTO things ("):
            raise RuntimeError("no")
        return run(self, sql, *values)

    monkeypatch.setattr(jdbc._Statements, "__call__", fail)
    with pytest.raises(RuntimeError):
        jdbc.write_once(df, url, "things", "b", driver=DRIVER)
    monkeypatch.setattr(jdbc._Statements, "__call__", run)
    assert len(rows_of(spark, url, "things")) == 10 and jdbc.write_once(df, url, "things", "b", driver=DRIVER) and len(rows_of(spark, url, "things")) == 20
