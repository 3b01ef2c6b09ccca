import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from domscope.operators import etl
from domscope.sources import files, lookup
from domscope.sources.daily import daily_feed, day_path
from domscope.streaming import feed


def test_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"# no\n\n x.com \nb\xffad.org\n")
    assert [r.domain for r in files.domain_list(spark, str(tmp_path / "a.txt")).collect()] == ["x.com", "bad.org"]
    (tmp_path / "a.csv").write_text("id,domain\n1,x.com\n2,\n3,  \n4,y.com\n")
    assert [r.domain for r in files.domain_list(spark, str(tmp_path / "a.csv")).collect()] == ["x.com", "y.com"]
    (tmp_path / "b.csv").write_text("name\n12\n")
    assert [r.domain for r in files.domain_list(spark, str(tmp_path / "b.csv")).collect()] == ["12"]
    (tmp_path / "o.txt").write_text("A,a.com,b\n#x\nB\nC, c.com\n")
    assert [tuple(r) for r in files.official_list(spark, str(tmp_path / "o.txt")).collect()] == [("A", "a.com,b"), ("C", "c.com")]
    (tmp_path / "o.csv").write_text("company,domain,z\nA, a.com ,1\n,b.com,\n")
    assert [tuple(r) for r in files.official_list(spark, str(tmp_path / "o.csv")).collect()] == [("A", "a.com"), ("nan", "b.com")]
    (tmp_path / "t.csv").write_text("domain,label\na.com,1\nb.com,2\nc.com\n,0\nd.com,0,x\ne.com,yes\n")
    t = files.training_list(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in t.collect()] == [("a.com", 1), ("", 0), ("d.com", 0)]
    assert files.preview(t).count() == 2


def test_staging(spark, tmp_path):
    (tmp_path / "o.csv").write_text('a,b,c,d,e,f,g,h,i,j,k\n1,"Team ""X""",A | B,cn,,x,y,2025/7/3,"two\nlines",,7\n,, ,,,,,,,,\n')
    orgs = etl.organizations(files.staged_csv(spark, str(tmp_path / "o.csv"), "organizations")).collect()
    assert len(orgs) == 1 and (orgs[0].name, orgs[0].alias, orgs[0].update_time, orgs[0].ioc_count, orgs[0].event_count, orgs[0].region) == ('Team "X"', ["A", "B"], date(2025, 7, 3), 0, 7, "未知")
    (tmp_path / "e.csv").write_bytes("h,h,h,h,h,h,h,h\n1,2024/1/5,标题,内容 C2,钓鱼攻击,1,p,l\n2,2024/1/5,t,,APT攻击,,p,\n".encode("gbk"))
    o = etl.organizations(files.staged_csv(spark, str(tmp_path / "o.csv"), "organizations"))
    e = etl.events(files.staged_csv(spark, str(tmp_path / "e.csv"), "events", "GBK"), o).orderBy("id").collect()
    assert [(r.title, r.event_type, r.severity, r.region, r.event_date) for r in e] == [("标题", "normal", 4, "未知", date(2024, 1, 5)), ("t", "major", 5, "未知", date(2024, 1, 5))]
    trends = etl.threat_trends(etl.events(files.staged_csv(spark, str(tmp_path / "e.csv"), "events", "GBK"), o)).first()
    assert (trends.c2_communication_count, trends.malware_count) == (1, 2)
    (tmp_path / "d.csv").write_text("h,h,h,h,h,h\n1,A.com,2,2024-01-05,45292,3\n2, a.COM ,,x,,\n3,,1,,,\n4,b.com,0,,,\n")
    staged = files.staged_csv(spark, str(tmp_path / "d.csv"), "domains")
    d = etl.domains(staged)
    assert [(r.id, r.domain_name, r.is_malicious, r.last_seen) for r in d.orderBy("id").collect()] == [(1, "a.com", True, date(2024, 1, 1)), (4, "b.com", False, None)]
    bare = d.withColumn("organization_id", F.lit(None).cast("int"))
    assert {r.id: r.organization_id for r in etl.backfill_organization(bare, staged).collect()} == {1: 3, 4: None}


def test_files_are_decoded_as_streams(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in 1"
    folder.mkdir()
    rows = [(str(n), f'标题 "{n}"\r\n，第{n % 7}行', "" if n % 3 else "x" * (n % 90)) for n in range(30_000)]
    df = spark.createDataFrame(rows, "a string, b string, c string").repartition(2)
    files.write_encoded_csv(df, str(folder), "GBK")
    wanted = {(a, b, c or None) for a, b, c in rows}
    back = files.staged_csv(spark, str(folder), ["a", "b", "c"], "GBK")
    # Spark's reader gives tasks the paths, not whole contents.
    assert "ReadSchema: struct<path:string>" in back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 30_000 and set(map(tuple, back.collect())) == wanted
    for name, data in (("utf_16", "a\r\n标,题\n"), ("utf16", "\ufeffa\n标,题\n"), ("utf_32", "a\n标,题")):
        (tmp_path / name).write_bytes(data.encode(f"{name.replace('_', '')[:3]}-{name[-2:]}-le"))
        assert [tuple(r) for r in files.staged_csv(spark, str(tmp_path / name), ["a", "b", "c"], name).collect()] == [("标", "题", None)]
    (tmp_path / "cut.csv").write_bytes("h\n标".encode("gbk")[:-1])
    assert [r.a for r in files.staged_csv(spark, str(tmp_path / "cut.csv"), ["a"], "GBK").collect()] == ["\ufffd"]
    damaged = b"h\n" + b"\x1babcdefghijk\xff" * 3000
    (tmp_path / "jp.csv").write_bytes(damaged)
    assert [r.a for r in files.staged_csv(spark, str(tmp_path / "jp.csv"), ["a"], "iso2022_jp").collect()] == [damaged[2:].decode("iso2022_jp", "replace")]
    # A store that only Spark reads: contents.
    monkeypatch.setattr(files, "whole_files", lambda spark, path: spark.read.format("binaryFile").load(path).select("path", "content"))
    assert set(map(tuple, files.staged_csv(spark, str(folder), ["a", "b", "c"], "GBK").collect())) == wanted


def test_daily_feed(spark, tmp_path):
    for day, member in ((date(2024, 9, 1), "dailyupdate.txt"), (date(2024, 9, 3), "other.txt"), (date(2024, 9, 5), "dailyupdate.txt")):
        p = day_path(str(tmp_path), day)
        (tmp_path / f"{day:%Y-%m}").mkdir(exist_ok=True)
        with zipfile.ZipFile(p, "w") as z:
            z.writestr(member, f"a.com\n\n b.com \n{day}.com\n")
    (tmp_path / "2024-09" / "2024-09-04-domain.zip").write_bytes(b"no zip")
    found, missing = daily_feed(spark, str(tmp_path), "2024-09-05", "2024-09-01", strict=True)
    assert {r.domain for r in found.collect()} == {"a.com", "b.com", "2024-09-01.com", "2024-09-05.com"}
    assert {(str(r.day), r.status) for r in missing.collect()} == {("2024-09-02", "missing"), ("2024-09-03", "unreadable"), ("2024-09-04", "unreadable")}
    with pytest.raises(ValueError):
        daily_feed(spark, str(tmp_path), "2024-08-01", "2024-09-01", strict=True)


def test_lookup(spark):
    def resolve(d):
        if d == "bad.com":
            raise TimeoutError("late")
        return {"whois": {"registrar": ["R", "S"], "name_servers": "ns1"}, "dns": [("MX", "10 mx.a.com.", 60), ("XX", "?", 1)], "certificate": {"subject_alt_names": [("DNS", "a.com"), ("IP", "1")]}}

    rows = {r.domain: r for r in lookup.look_up(spark.createDataFrame([("a.com",), ("a.com",), ("bad.com",), (None,)], "domain string"), resolve).collect()}
    a = rows["a.com"]
    assert (a.registrar, a.name_servers, a.san_names, a.dns[0].record_value, a.dns[0].priority, len(a.dns)) == ("R", ["ns1"], ["a.com"], "mx.a.com", 10, 1)
    assert rows["bad.com"].error == "TimeoutError: late" and len(rows) == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b.com", 1), ("a.com", 1), ("c.com", 0)], "domain string, predicted int")
    files.write_results(str(tmp_path / "r"), df, df.agg(F.count("*").alias("total")), df.where("predicted = 1"))
    assert files.read_results(spark, str(tmp_path / "r"), F.col("predicted") == 1)["positive"].count() == 2
    files.write_alert_csv(df, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text.splitlines() == ["﻿序号,恶意域名", "1,a.com", "2,b.com", "3,c.com"]
    assert files.document_path(date(2024, 1, 5), 1, "s", "t", "a") == "alerts/2024/01/05/user_1/subscription_s/task_t/alert_a/full_result.json"


def test_arriving_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n, (day, text) in enumerate((("2024-01-03", "a.com\nb.com\n"), ("2024-01-02", "late.com\n#x\n"))):
        (folder / f"{day}-domains.txt").write_text(text)
        feed.run_available(feed.arriving_domains(spark, str(folder)), state, feed.into_batches(out))
    rows = spark.read.parquet(out).collect()
    assert {(r.domain, str(r.day)) for r in rows} == {("a.com", "2024-01-03"), ("b.com", "2024-01-03"), ("late.com", "2024-01-02")} and len(rows) == 3


def test_spreadsheets(spark, tmp_path):
    from domscope.sources import xlsx

    df = spark.createDataFrame([("b.com", "1 < 2 & \"x\""), ("a.com", None), (" ", "é\x01日本\n  two")], "domain string, note string")
    path = str(tmp_path / "r.xlsx")
    xlsx.write_result_book(path, df, df.agg(F.count("*").alias("total")), df.limit(0))
    back = xlsx.read_xlsx(spark, path)
    assert back.columns == ["domain", "note"] and {tuple(r) for r in back.collect()} == {("b.com", '1 < 2 & "x"'), ("a.com", None), (" ", "é日本\n  two")}
    assert xlsx.read_xlsx(spark, path, "统计信息").first().total == "3"
    assert sorted(r.domain for r in xlsx.domain_sheet(spark, path).collect()) == ["a.com", "b.com"]
    with pytest.raises(Exception):
        xlsx.read_xlsx(spark, path, "钓鱼域名列表").count()
    xlsx.write_result_book(path, df, df.limit(1), df.where("domain = 'a.com'"), "impersonation")
    assert xlsx.read_xlsx(spark, path, "钓鱼域名列表").count() == 1


def test_a_result_longer_than_a_sheet(spark, tmp_path):
    from domscope.sources import xlsx

    n = xlsx.MOST_ROWS + 5
    path = str(tmp_path / "a b.xlsx")
    rows = spark.range(n).selectExpr("concat('d', id) AS domain", "id % 7 AS size")
    xlsx.write_result_book(path, rows, rows.agg(F.count("*").alias("total")), rows.where("id < 3"), "impersonation")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and "钓鱼域名列表" in z.read("xl/workbook.xml").decode() and "检测结果 (2)" in z.read("xl/workbook.xml").decode()
        assert [z.read(f"xl/worksheets/sheet{k}.xml").count(b"<row>") <= xlsx.MOST_ROWS for k in (1, 2)] == [True, True]
    back = xlsx.read_xlsx(spark, path, "检测结果")
    assert back.columns == ["domain", "size"] and back.rdd.getNumPartitions() == 2
    assert back.selectExpr("count(*)", "count(DISTINCT domain)", "sum(size)").first() == rows.selectExpr("count(*)", "count(DISTINCT domain)", "sum(CAST(size AS double))").first()
    assert xlsx.read_xlsx(spark, path, "统计信息").first().total == str(n) and xlsx.read_xlsx(spark, path, "钓鱼域名列表").count() == 3


def test_domains_of_a_result_longer_than_a_sheet(spark, tmp_path):
    from domscope.sources import xlsx

    n = xlsx.MOST_ROWS
    path = str(tmp_path / "r.xlsx")
    rows = spark.range(n).selectExpr("if(id % 2 = 0, concat('d', id), ' ') AS domain")
    xlsx.write_result_book(path, rows, rows.agg(F.count("*").alias("total")), rows)
    # The first sheet and the positive rows both go on.
    assert xlsx.domain_sheet(spark, path).selectExpr("count(*)", "count(DISTINCT domain)").first() == (n // 2, n // 2)
    assert xlsx.read_xlsx(spark, path, "恶意域名列表").count() == n


def test_sheets_that_go_on(spark, tmp_path, monkeypatch):
    import io

    from domscope.sources import xlsx

    monkeypatch.setattr(xlsx, "MOST_ROWS", 11)
    path = str(tmp_path / "r.xlsx")
    rows = spark.range(35).repartition(3).selectExpr("lpad(id, 3, '0') AS k", "if(id % 2 = 0, 'é<日', null) AS v")
    xlsx.write_xlsx(path, {"x" * 40: rows, "a": spark.range(0), "a (2)": spark.range(1), "A": rows.limit(10), "a ": rows.limit(11)}, "k")
    with open(path, "rb") as f:
        content = f.read()
    whole = list(xlsx.sheet_rows(content, "x" * 31))
    assert whole == [["k", "v"]] + [[f"{n:03}", None if n % 2 else "é<日"] for n in range(35)] == list(xlsx.sheet_rows(content, None))
    assert [len(list(xlsx.sheet_rows(content, n))) for n in ("a", "a (2)", "A", "a ")] == [1, 2, 11, 12]
    # A sheet that only has such a name is a sheet of its own; files are read as streams or, from other stores, as contents.
    assert len(list(xlsx.part_rows(io.BytesIO(content), "xl/worksheets/sheet1.xml"))) <= 11
    assert xlsx.read_xlsx(spark, path).count() == 35 == xlsx.read_xlsx(spark, str(tmp_path)).count()
    monkeypatch.setattr(xlsx.files, "whole_files", lambda spark, path: spark.read.format("binaryFile").load(path).select("path", "content"))
    assert sorted(map(tuple, xlsx.read_xlsx(spark, path).collect())) == [tuple(r) for r in whole[1:]]


def test_zip_of_long_members(monkeypatch):
    import io

    from domscope.sources import xlsx

    pieces = [(d, crc, length, len(d)) for d, crc, length in (xlsx._packed("one ", False), xlsx._packed("two", True))]
    for limit in (zipfile.ZIP64_LIMIT, 60, 3):  # sizes and places beyond it are written with 64 bits
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        book = b"".join(xlsx._archive([("a", pieces), ("b", pieces[1:])]))
        with zipfile.ZipFile(io.BytesIO(book)) as z:
            assert z.testzip() is None and (z.read("a"), z.read("b")) == (b"one two", b"two")
        assert (b"PK\6\6" in book) == (limit < 100)


def test_jdbc(spark):
    from domscope.sources import jdbc

    url, driver = "jdbc:derby:memory:scan;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(100).selectExpr("id", "id % 7 AS g", "CAST(id AS string) AS name")
    jdbc.write_jdbc(rows.union(spark.sql("SELECT NULL, NULL, 'none'")), url, "things", driver=driver, connections=1)
    got = jdbc.jdbc_table(spark, url, "things", split_on="id", parts=4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 101 and got.where("id IS NULL").count() == 1
    plan = got.where("G = 3").select("NAME")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(g,3)" in plan and "ReadSchema: struct<name:string>" in plan
    assert jdbc.jdbc_table(spark, url, "things", driver=driver).where("G = 3").count() == 14
    assert jdbc.jdbc_table(spark, url, "(SELECT * FROM things WHERE \"id\" < 0) t", split_on="id", driver=driver).count() == 0


def test_a_document_goes_when_its_row_fails(spark, tmp_path):
    import os

    import pytest

    body = spark.createDataFrame([("{}",)], "document string")

    def fails(row):
        raise OSError("no")

    with pytest.raises(OSError):
        files.store_document(body, str(tmp_path), "a/full.json", body, fails)
    assert not os.path.exists(f"{tmp_path}/a/full.json")
    with pytest.raises(Exception):
        files.get_objects(spark, f"{tmp_path}/none").count()
