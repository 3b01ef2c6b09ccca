"""Queries of files, staged tables, schedules, the catalog and texts, on the driver's tables, each with SQL.

What the engine reads as files - staged CSV, lists, workbooks, daily ZIPs - is written from the tables first, to the folder
that driver and executors share.
"""

from __future__ import annotations

import io
import zipfile
from datetime import date

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import cleaning, labels, names
from .operators import attribution, catalog, client, detection, entities, etl, housekeeping, lookalike
from .plans.relational import in_order, page
from .registry import query
from .registry import table as _t
from .session import scratch, stored
from .sources import archives, files, jdbc, lookup, xlsx
from .sources.daily import MEMBER, daily_feed, day_path
from .sources.stitched import write_stitched
from .streaming import feed, schedule

_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _s(c: str):
    return F.col(c).cast("string")


def _csv(df, name: str) -> str:
    path = f"{scratch(df.sparkSession, 'files')}/{name}"
    df.write.options(**_CSV).csv(path)
    return path


def _text(df, name: str) -> str:
    path = f"{scratch(df.sparkSession, 'files')}/{name}"
    df.write.text(path)
    return path


# Staged tables ---------------------------------------------------------------------------------------------


@query("""
SELECT CAST(c_custkey AS INT) AS id, trim(' ' || c_name || ' "q", ') AS name, c_name || ',' || c_mktsegment AS alias, make_date(2024, CAST(c_custkey % 12 + 1 AS INT), CAST(c_custkey % 28 + 1 AS INT)) AS update_time,
  c_mktsegment AS region, CASE WHEN c_custkey % 5 = 0 THEN '未知' ELSE 'N' || c_nationkey END AS origin, 'one' || chr(10) || 'two' AS description, CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey END AS INT) AS ioc_count, 0 AS event_count, 'a,b' AS industries
FROM customer WHERE c_custkey % 13 > 0
""")
def staged_organizations(spark, sf_dir):
    """A staged CSV with quotes, line ends and blanks, typed."""
    k = F.col("c_custkey")
    staged = _t(spark, sf_dir, "customer").select(
        _s("c_custkey"), F.when(k % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(' "q", '))), F.concat_ws(" | ", "c_name", "c_mktsegment"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("N"), "c_nationkey")),
        F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")), F.lit(""), F.lit("a | b"), F.concat(F.lit("2024/"), k % 12 + 1, F.lit("/"), k % 28 + 1), F.lit("one\ntwo"), F.when(k % 7 == 0, "").otherwise(_s("c_custkey")), F.lit("x"),
    ).toDF(*[f"h{n}" for n in range(11)])
    orgs = etl.organizations(files.staged_csv(spark, _csv(staged, "organizations.csv"), "organizations"))
    return orgs.select("id", "name", F.array_join("alias", ",").alias("alias"), "update_time", "region", "origin", "description", "ioc_count", "event_count", F.array_join("target_industries", ",").alias("industries"))


_THREATS = ("供应链攻击", "C2通信", "钓鱼攻击", "其他")


@query("""
SELECT CAST(event_id AS INT) AS id, CAST(ts AS DATE) AS event_date, '标题 ' || event_type AS title, CASE event_id % 4 WHEN 0 THEN 'major' ELSE 'normal' END AS event_type, CASE event_id % 4 WHEN 0 THEN 5 WHEN 3 THEN 3 ELSE 4 END AS severity,
  coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, '未知') AS region, CASE WHEN event_id % 2 = 0 THEN 'http://x/' || event_id END AS report_url FROM events LEFT JOIN customer ON user_id = c_custkey
""")
def staged_events(spark, sf_dir):
    """A staged CSV in GBK, typed, with the region of each event's organization."""
    threat = F.element_at(F.array(*map(F.lit, _THREATS)), (F.col("event_id") % 4 + 1).cast("int"))
    staged = _t(spark, sf_dir, "events").select(
        _s("event_id").alias("id"), F.date_format("ts", "yyyy/M/d").alias("event_date"), F.concat(F.lit(" 标题 "), "event_type").alias("title"), F.lit("内容").alias("description"), threat.alias("threat_type"), _s("user_id").alias("organization_id"),
        F.lit("p").alias("releasing_product"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("http://x/"), "event_id")).otherwise(" ").alias("link"),
    )
    path = f"{scratch(spark, 'files')}/events.csv"
    files.write_encoded_csv(staged, path, "GBK")
    orgs = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("region"))
    return etl.events(files.staged_csv(spark, path, "events", "GBK"), orgs).select("id", "event_date", "title", "event_type", "severity", "region", "report_url")


@query("""
SELECT id, domain_name, is_malicious, first_seen, last_seen, organization_id FROM (SELECT CAST(event_id AS INT) AS id, lower(event_type) || (user_id % 500) || '.com' AS domain_name, event_id % 3 > 0 AS is_malicious, CAST(ts AS DATE) AS first_seen,
  CAST(ts AS DATE) AS last_seen, CAST(user_id AS INT) AS organization_id, row_number() OVER (PARTITION BY lower(event_type), user_id % 500 ORDER BY event_id) AS k FROM events) WHERE k = 1
""")
def staged_domains(spark, sf_dir):
    """Domains once for each lower-case name; dates as text and as a spreadsheet's day numbers."""
    serial = F.datediff(F.to_date("ts"), F.lit("1899-12-30").cast("date")).cast("string")
    staged = _t(spark, sf_dir, "events").select(_s("event_id"), F.concat(F.upper("event_type"), F.col("user_id") % 500, F.lit(".COM ")), (F.col("event_id") % 3).cast("string"), F.date_format("ts", "yyyy-MM-dd"), serial, _s("user_id")).toDF(*[f"h{n}" for n in range(6)])
    return etl.domains(files.staged_csv(spark, _csv(staged, "domains.csv"), "domains")).select("id", "domain_name", "is_malicious", "first_seen", "last_seen", "organization_id")


@query("""
WITH t AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 WHEN p_partkey % 2 = 1 THEN p_size WHEN p_partkey % 5 = 0 THEN p_size + 200 END AS o FROM part)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(o) AS BIGINT) AS filled, CAST(count(*) - count(o) AS BIGINT) AS missing, CAST(sum(o) AS BIGINT) AS checksum FROM t
""")
def organizations_backfilled(spark, sf_dir):
    """Domains get the organization of the staged row of their id, else of their name; then the audit."""
    p = _t(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit("-"), "p_partkey", F.lit(".com"))
    table = p.select(F.col("p_partkey").cast("int").alias("id"), name.alias("domain_name"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_size")).alias("organization_id"))
    by_id = p.where("p_partkey % 3 = 0").select(_s("p_partkey").alias("id"), F.lit("").alias("domain_name"), (F.col("p_size") + 100).cast("string").alias("organization_id"))
    by_name = p.where("p_partkey % 5 = 0").select(F.lit("").alias("id"), F.upper(name).alias("domain_name"), (F.col("p_size") + 200).cast("string").alias("organization_id"))
    filled = etl.backfill_organization(table, by_id.unionByName(by_name))
    return etl.audit(filled, "organization_id").join(filled.agg(F.sum("organization_id").alias("checksum")))


@query("SELECT CAST(event_id AS INT) AS id, CASE WHEN event_id % 2 = 1 THEN 'own' WHEN event_id % 3 = 0 THEN 'http://x/' || event_id END AS report_url FROM events")
def links_backfilled(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    staged = e.where("event_id % 3 = 0").select(_s("event_id").alias("id"), F.concat(F.lit(" http://x/"), "event_id").alias("link"))
    return etl.backfill_links(e.select(F.col("event_id").cast("int").alias("id"), F.when(F.col("event_id") % 2 == 1, "own").alias("report_url")), staged).select("id", "report_url")


@query("""
SELECT CAST(ts AS DATE) AS trend_date, 0::BIGINT AS dns_tunnel_count, 0::BIGINT AS dga_domain_count, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS phishing_count, CAST(count(*) FILTER (WHERE event_id % 2 = 0) AS BIGINT) AS c2_communication_count,
  CAST(count(*) AS BIGINT) AS malware_count FROM events GROUP BY 1
""")
def threat_trends_built(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.to_date("ts").alias("event_date"), F.when(F.col("event_type") == "error", "钓鱼页面").otherwise("x").alias("title"), F.when(F.col("event_id") % 2 == 0, "via C2").alias("description"))
    return etl.threat_trends(e)


# Lists and sinks -------------------------------------------------------------------------------------------


@query("SELECT p_name || p_partkey || '.com' AS domain, 'txt' AS kind FROM part WHERE p_partkey % 10 > 1 UNION ALL SELECT p_name || '-' || p_partkey, 'csv' FROM part WHERE p_partkey % 10 > 0")
def domain_lists(spark, sf_dir):
    """Lists of domains as text, with remarks and blank lines, and as CSV."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey") % 10
    text = p.select(F.when(k == 0, F.concat(F.lit("# "), "p_name")).when(k == 1, "   ").otherwise(F.concat(F.lit("  "), "p_name", "p_partkey", F.lit(".com "))).alias("value"))
    table = p.select(_s("p_partkey").alias("n"), F.when(k == 0, "  ").otherwise(F.concat("p_name", F.lit("-"), "p_partkey")).alias("domain"))
    return files.domain_list(spark, _text(text, "names.txt")).withColumn("kind", F.lit("txt")).unionByName(files.domain_list(spark, _csv(table, "names.csv")).withColumn("kind", F.lit("csv")))


@query("""
SELECT p_brand AS company, p_name || p_partkey || '.com' AS domain, 'csv' AS kind FROM part WHERE p_partkey % 10 > 0
UNION ALL SELECT p_brand, p_name || p_partkey || ',more', 'txt' FROM part WHERE p_partkey % 10 > 1
""")
def official_lists(spark, sf_dir):
    """Pairs of company and domain, from CSV and from text."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey") % 10
    table = p.select(F.when(k == 0, "  ").otherwise(F.concat(F.lit(" "), "p_brand")).alias("a"), F.concat("p_name", "p_partkey", F.lit(".com ")).alias("b"), F.lit("x").alias("c"))
    text = p.select(F.when(k == 0, "# none").when(k == 1, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(" , "), "p_name", "p_partkey", F.lit(",more"))).alias("value"))
    return files.official_list(spark, _csv(table, "official.csv")).withColumn("kind", F.lit("csv")).unionByName(files.official_list(spark, _text(text, "official.txt")).withColumn("kind", F.lit("txt")))


@query("SELECT p_name || p_partkey AS domain, CAST(p_partkey % 3 AS INT) AS label FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 7 > 0")
def training_rows(spark, sf_dir):
    """Labelled lines; those with another label or none are left out."""
    k = F.col("p_partkey")
    text = _t(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_name", "p_partkey", F.when(k % 7 == 0, F.lit(" no label")).otherwise(F.concat(F.lit(" , "), (k % 3).cast("string"), F.lit(" ,more")))).alias("value"))
    return files.training_list(spark, _text(text, "training.csv"))


@query("""
SELECT p_name || p_partkey AS domain, CAST(p_size AS VARCHAR) AS size, 'all' AS sheet FROM part UNION ALL SELECT p_name || p_partkey, CAST(p_size AS VARCHAR), 'positive' FROM part WHERE p_size > 25
UNION ALL SELECT p_name || p_partkey, NULL, 'first' FROM part
""")
def result_book(spark, sf_dir):
    """A workbook of results, written and read back: the first sheet, the positive rows, and the list of domains."""
    rows = _t(spark, sf_dir, "part").select(F.concat("p_name", "p_partkey").alias("domain"), F.col("p_size").alias("size"))
    path = f"{scratch(spark, 'files')}/result.xlsx"
    xlsx.write_result_book(path, rows, rows.agg(F.count(F.lit(1)).alias("total")), rows.where("size > 25"))
    whole, some = xlsx.read_xlsx(spark, path).withColumn("sheet", F.lit("all")), xlsx.read_xlsx(spark, path, "恶意域名列表").withColumn("sheet", F.lit("positive"))
    first = xlsx.domain_sheet(spark, path).select("domain", F.lit(None).cast("string").alias("size"), F.lit("first").alias("sheet"))
    return whole.unionByName(some).unionByName(first).select("domain", "size", "sheet")


@query("""
SELECT kind, domain, size FROM (SELECT 'results' AS kind, p_name || p_partkey AS domain, p_size AS size FROM part UNION ALL SELECT 'positive', p_name || p_partkey, p_size FROM part WHERE p_size > 25 UNION ALL SELECT 'statistics', NULL, CAST(count(*) AS INT) FROM part)
""")
def result_tables(spark, sf_dir):
    """The same as tables; the positive rows are picked anew where they were not stored."""
    rows = _t(spark, sf_dir, "part").select(F.concat("p_name", "p_partkey").alias("domain"), F.col("p_size").alias("size"))
    path = scratch(spark, "results")
    for name, df in (("results", rows), ("statistics", rows.agg(F.count(F.lit(1)).cast("int").alias("size")).select(F.lit(None).cast("string").alias("domain"), "size"))):
        df.write.parquet(f"{path}/{name}")
    stored = files.read_results(spark, path, F.col("size") > 25)
    out = None
    for kind, df in stored.items():
        df = df.select(F.lit(kind).alias("kind"), "domain", "size")
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT CAST(row_number() OVER (ORDER BY p_name || '-' || p_partkey) AS INT) AS number, p_name || '-' || p_partkey AS domain FROM part WHERE p_size > 40")
def alert_table(spark, sf_dir):
    """The numbered CSV of an alert, read back."""
    path = f"{scratch(spark, 'files')}/alert.csv"
    files.write_alert_csv(_t(spark, sf_dir, "part").where("p_size > 40").select(F.concat("p_name", F.lit("-"), "p_partkey").alias("domain")), path)
    return spark.read.schema("number int, domain string").options(header=True, enforceSchema=True).csv(path)


@query("""
SELECT 'alerts/2024/01/05/user_7/subscription_s/task_t/alert_a/full_result.json' AS path, CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS total, '高' AS level FROM part
""")
def alert_text(spark, sf_dir):
    """An alert's document, stored under its path and read back."""
    inner = files.document_path(date(2024, 1, 5), 7, "s", "t", "a")
    path = f"{scratch(spark, 'files')}/{inner}"
    body = _t(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total")).select(F.to_json(F.struct("n", "total", F.lit("高").alias("level"))).alias("document"))
    files.write_document(body, path)
    return spark.read.text(path).select(F.lit(inner).alias("path"), F.from_json("value", "n long, total long, level string").alias("d")).select("path", "d.*")


@query("""
SELECT 'alerts' AS bucket, 'alerts/2024/01/05/user_7/subscription_s/task_t/alert_a/full_result.json' AS object_key, 'full_result.json' AS filename, CAST(octet_length(encode(d)) AS BIGINT) AS size, 'full_result' AS artifact_type, '7' AS user_id, d AS document
FROM (SELECT '{"n":' || count(*) || ',"level":"高"}' AS d FROM part)
""")
def document_registered(spark, sf_dir):
    """An alert's document with its row of the table of files, read back."""
    root, when = scratch(spark, "files"), F.lit("2024-01-05 00:00:00")
    inner = files.document_path(date(2024, 1, 5), 7, "s", "t", "a")
    body = _t(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n")).select(F.to_json(F.struct("n", F.lit("高").alias("level"))).alias("document"))
    row = files.document_row(body, "alerts", inner, {"alert_id": "a", "user_id": 7}, when)
    files.store_document(body, f"{root}/alerts", inner, row, lambda r: files.append(r, f"{root}/files"))
    metadata = [F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("artifact_type", "user_id")]
    return spark.read.parquet(f"{root}/files").select("bucket", "object_key", "filename", "size", *metadata).join(spark.read.text(f"{root}/alerts/{inner}").select(F.col("value").alias("document")))


@query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS digest, 32 + 5 AS key_length FROM pages WHERE html IS NOT NULL")
def uploaded_object(spark, sf_dir):
    """The html of all pages as objects under random keys, written by tasks, found by key and read again."""
    bucket = f"{scratch(spark, 'files')}/pages"
    keys = files.put_objects(_t(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.encode("html", "UTF-8").alias("content")), bucket, "html")
    found = files.get_objects(spark, bucket).select("key", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"))
    return found.join(keys, "key").select("page_id", "size", "digest", F.char_length("key").alias("key_length"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 3)")
def database_rows(spark, sf_dir):
    """A table of a database, written exactly once though its batch is sent twice, and read in ranges, with filter and columns pushed down."""
    url, driver = f"jdbc:derby:memory:{scratch(spark, 'x').rpartition('-')[2]};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    for _ in range(2):
        jdbc.write_once(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), url, "nation", "first", connections=1, driver=driver)
    return stored(jdbc.jdbc_table(spark, url, "nation", split_on="n_nationkey", parts=4, driver=driver).where("n_regionkey IN (1, 3)"), "nation")


@query("SELECT event_id, user_id, CAST(NULL AS DOUBLE) AS weight FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id, NULL FROM events WHERE event_id % 2 = 1")
def appended_rows(spark, sf_dir):
    """Rows appended in two batches, read back with a column that the table lacks."""
    path = f"{scratch(spark, 'files')}/events"
    e = _t(spark, sf_dir, "events").select("event_id", "user_id")
    for n in range(2):
        files.append(e.where(F.col("event_id") % 2 == n), path)
    return files.with_columns(spark.read.parquet(path), weight="double", user_id="long")


_FEED = "lower(event_type) || (user_id % 700) || '.example.com'"


@query(f"""
WITH e AS (SELECT DISTINCT {_FEED} AS domain, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-10')
SELECT DISTINCT domain, 'read' AS status FROM e WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-02-05'
UNION ALL SELECT CAST(CAST(d AS DATE) AS VARCHAR), 'missing' FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) AS g(d) WHERE CAST(d AS DATE) NOT IN (SELECT day FROM e)
""")
def daily_feed_distinct(spark, sf_dir):
    """Domains of the daily ZIPs of five weeks, each once, and the days without a file."""
    root = scratch(spark, "feed")
    e = _t(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.concat(F.upper("event_type"), F.col("user_id") % 700, F.lit(".example.com")).alias("domain"))
    _daily_files(e.select("day", F.lower("domain").alias("domain")).where("day <> date'2024-01-10'"), lambda day: day_path(root, day), _zipped)
    found, gone = daily_feed(spark, root, "2024-02-05", "2024-01-01")
    return found.select("domain", F.lit("read").alias("status")).unionByName(gone.select(_s("day").alias("domain"), "status"))


def _zipped(text: bytes) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr(MEMBER, text)
    return data.getvalue()


def _daily_files(rows, path_of, packed) -> None:
    """One file for each day, of the domains of (day, domain); a day is one file by the format."""

    def write(group: pa.Table) -> pa.Table:
        import pyarrow.fs as pafs

        day = group["day"][0].as_py()
        fs, inner = pafs.FileSystem.from_uri(path_of(day))
        fs.create_dir(inner.rpartition("/")[0])
        with fs.open_output_stream(inner, compression=None) as f:
            f.write(packed(("\n".join(group["domain"].to_pylist()) + "\n\n").encode()))
        return pa.table({"n": [group.num_rows]})

    rows.distinct().groupBy("day").applyInArrow(write, "n long").agg(F.sum("n")).collect()


@query("SELECT DISTINCT lower(event_type) || (user_id % 700) AS domain, CAST(ts AS DATE) AS day FROM events")
def arriving_files(spark, sf_dir):
    """Daily text files as a stream: all that is there, then again when nothing is new; each file counts once."""
    root = scratch(spark, "arriving")
    e = _t(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.concat(F.lower("event_type"), F.col("user_id") % 700).alias("domain"))
    out, seen = scratch(spark, "arrived"), scratch(spark, "seen")
    for late in (False, True):  # the first days come last
        _daily_files(e.where((F.col("day") < "2024-01-08") == late), lambda day: f"{root}/{day}.txt", bytes)
        feed.run_available(feed.arriving_domains(spark, root, 5), seen, feed.into_batches(out))
    feed.run_available(feed.arriving_domains(spark, root, 5), seen, feed.into_batches(out))
    return spark.read.parquet(out).select("domain", "day")


@query("""
SELECT 'd' || p_partkey || '.com' AS domain, CASE WHEN p_partkey % 9 > 0 THEN 'R' || p_partkey % 4 END AS registrar, CASE WHEN p_partkey % 9 > 0 THEN 2 ELSE 0 END AS n_dns, CASE WHEN p_partkey % 9 > 0 THEN '10' END AS priority,
  CASE WHEN p_partkey % 9 > 0 THEN 'ns.x' ELSE '' END AS servers, CASE WHEN p_partkey % 9 = 0 THEN 'LookupError: no such name' END AS error FROM part
""")
def looked_up(spark, sf_dir):
    """Attributes from a resolver that the caller brings; names that fail are results too."""

    def resolve(domain: str) -> dict:
        n = int(domain[1:].partition(".")[0])
        if n % 9 == 0:
            raise LookupError("no such name")
        return {"whois": {"registrar": [f"R{n % 4}", "other"], "name_servers": "ns.x"}, "dns": [("MX", "10 mail.x.", 60), ("A", "1.2.3.4", 60), ("TYPE9", "?", 1)]}

    found = lookup.look_up(_t(spark, sf_dir, "part").select(F.concat(F.lit("d"), "p_partkey", F.lit(".com")).alias("domain")), resolve)
    mx = F.filter("dns", lambda r: r["record_type"] == "MX")
    return found.select("domain", "registrar", F.size("dns").alias("n_dns"), F.try_element_at(mx, F.lit(1))["priority"].cast("string").alias("priority"), F.array_join("name_servers", ",").alias("servers"), "error")


# Schedules -------------------------------------------------------------------------------------------------


@query("""
SELECT c_custkey AS id, n <= TIMESTAMP '2024-01-31 12:00:00' AS due, n <= TIMESTAMP '2024-01-31 12:00:00' AND n >= TIMESTAMP '2024-01-30 12:00:00' AS missed
FROM (SELECT c_custkey, TIMESTAMP '2024-01-29 00:00:00' + to_hours(CAST(c_custkey % 96 AS INT)) AS n FROM customer WHERE c_custkey % 3 > 0) WHERE n <= TIMESTAMP '2024-01-31 12:00:00'
""")
def due_subscriptions(spark, sf_dir):
    k = F.col("c_custkey")
    at = F.lit("2024-01-29 00:00:00").cast("timestamp_ntz") + F.make_interval(hours=(k % 96).cast("int"))
    subs = _t(spark, sf_dir, "customer").select(k.alias("id"), at.alias("next_run_at"), (k % 3 > 0).alias("is_active"))
    now = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    late = schedule.missed(subs, now).select("id", F.lit(True).alias("missed"))
    return schedule.due(subs, now).select("id", F.lit(True).alias("due")).join(late, "id", "left").select("id", "due", F.coalesce("missed", F.lit(False)).alias("missed"))


def _tasks(spark, sf_dir):
    k = F.col("o_orderkey")
    span = F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add(F.to_date("o_orderdate"), 6), "yyyy-MM-dd"))
    extra = F.to_json(F.struct((k % 50).cast("string").alias("subscription_id"), span.alias("dateRange"), F.when(k % 4 == 0, "a.xlsx").alias("result_file_key")))
    return _t(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 100).cast("string").alias("created_by"), (k % 7).alias("model_id"), F.col("o_orderdate").alias("created_at"), F.when(k % 9 > 0, extra).alias("extra"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))


@query("""
WITH t AS (SELECT o_orderkey AS id, CAST(o_custkey % 100 AS VARCHAR) AS created_by, o_orderkey % 7 AS model_id, o_orderdate AS d FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY created_by, model_id ORDER BY d DESC, id DESC) AS k FROM t)
SELECT 'newest' AS kind, created_by || '/' || model_id AS name, CASE WHEN id % 9 > 0 THEN CAST(id % 50 AS VARCHAR) END AS subscription_id, CASE WHEN id % 9 > 0 THEN CAST(d AS DATE) + 6 END AS last FROM w WHERE k = 1
UNION ALL SELECT 'own', '', CAST(id % 50 AS VARCHAR), max(CAST(d AS DATE) + 6) FROM t WHERE id % 9 > 0 GROUP BY id % 50
""")
def high_water_marks(spark, sf_dir):
    """Up to which day tasks have read: of the newest task of each user and model, and of each subscription."""
    tasks = _tasks(spark, sf_dir)
    one = schedule.high_water(tasks).select(F.lit("newest").alias("kind"), F.concat("created_by", F.lit("/"), "model_id").alias("name"), "subscription_id", "last")
    return one.unionByName(schedule.own_high_water(tasks).select(F.lit("own").alias("kind"), F.lit("").alias("name"), "subscription_id", "last"))


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 4 = 0) OR o_orderkey % 9 = 0")
def unfinished_tasks(spark, sf_dir):
    return schedule.unfinished(_tasks(spark, sf_dir)).select("id")


@query("""
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'yearly' END AS f, CAST(o_orderdate AS DATE) AS today, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) - CAST((o_orderkey * 7) % 40 AS INT) END AS last,
  CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INT)) AS now FROM orders),
s AS (SELECT *, CASE f WHEN 'daily' THEN 1 WHEN 'monthly' THEN 30 ELSE 7 END AS s FROM r),
w AS (SELECT *, CASE WHEN last IS NULL THEN today - s WHEN last + 1 > today - 1 THEN NULL WHEN f = 'yearly' THEN last + 1 ELSE greatest(last + 1, today - s) END AS first_day FROM s)
SELECT o_orderkey, f AS frequency, CAST(first_day AS DATE) AS first_day, CASE WHEN first_day IS NOT NULL THEN CAST(today - 1 AS DATE) END AS last_day,
  CAST(CAST(now AS DATE) + CASE WHEN hour(now) >= 9 THEN 1 ELSE 0 END + CASE f WHEN 'daily' THEN 0 WHEN 'weekly' THEN 7 WHEN 'monthly' THEN 30 ELSE 1 END AS DATE) AS next_day, 9 AS next_hour FROM w
""")
def planned_windows(spark, sf_dir):
    """The days that a run for each order would read, and when the next one is."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 4 == 0, "daily").when(k % 4 == 1, "weekly").when(k % 4 == 2, "monthly").otherwise("yearly").alias("frequency"), day.alias("today"),
        F.when(k % 5 > 0, F.date_sub(day, ((k * 7) % 40).cast("int"))).alias("last"), (day.cast("timestamp") + F.make_interval(hours=(k % 24).cast("int"))).alias("now"),
    )
    out = schedule.next_runs(schedule.windows(rows))
    return out.select("o_orderkey", "frequency", "first_day", "last_day", F.to_date("next_run").alias("next_day"), F.hour("next_run").alias("next_hour"))


_READ = "SELECT DISTINCT o_custkey AS s, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 3 > 0"


@query(f"""
WITH r AS ({_READ}), own AS (SELECT c_custkey AS s, DATE '1995-01-01' + CAST(c_custkey % 900 AS INT) AS since FROM customer), u AS (SELECT DATE '1998-06-30' AS upto),
days AS (SELECT s, since - 1 AS d FROM own UNION ALL SELECT s, upto + 1 FROM own, u UNION ALL SELECT r.s, d FROM r JOIN own ON own.s = r.s, u WHERE d BETWEEN since AND upto),
g AS (SELECT s, CAST(d + 1 AS DATE) AS a, CAST(lead(d) OVER (PARTITION BY s ORDER BY d) - 1 AS DATE) AS z FROM days)
SELECT s AS subscription_id, a AS first_day, z AS last_day FROM g WHERE a <= z
""")
def unread_days(spark, sf_dir):
    """The runs of days that each subscription - a customer - hasn't read, late and missed ones among them."""
    own = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subscription_id"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")).alias("since"))
    read = _t(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("subscription_id"), F.to_date("o_orderdate").alias("day"))
    return schedule.unread(own, read, F.lit("1998-06-30").cast("date"))


# Codes and texts -------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'major' ELSE 'normal' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 3 THEN 3 ELSE 4 END AS severity, CASE WHEN x IS NULL THEN 'unknown' WHEN x >= 0.8 THEN 'high' WHEN x >= 0.5 THEN 'medium' ELSE 'low' END AS risk,
  CASE WHEN coalesce(x, 0) > 0 THEN printf('%.4f', x) ELSE '' END AS similarity, round(CASE WHEN p > 0 AND p < 100 AND e > 0 AND o_orderstatus = 'F' THEN (100 - p) / (p / CAST(e AS DOUBLE)) END, 6) AS eta,
  o_orderkey % 3 = 0 AND (o_orderkey % 10 = 7 OR o_orderkey % 12 = 7) AS editable, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'idle' END AS training, CASE o_orderkey % 3 WHEN 0 THEN '恶意性检测' WHEN 1 THEN '仿冒域名检测' END AS category
FROM (SELECT *, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 1000) / 1000.0::DOUBLE END AS x, o_orderkey % 120 AS p, o_orderkey % 50 AS e FROM orders)
""")
def code_labels(spark, sf_dir):
    """What codes and numbers are shown as."""
    k = F.col("o_orderkey")
    threat = F.element_at(F.array(*map(F.lit, _THREATS)), (k % 4 + 1).cast("int"))
    x = F.when(k % 11 > 0, (k % 1000) / 1000.0)
    state = F.when(F.col("o_orderstatus") == "F", "training").when(F.col("o_orderstatus") == "O", "pending")
    editable = labels.editable(F.when(k % 3 == 0, "custom").otherwise("official"), F.concat(F.lit("u"), k % 10), (k % 12).cast("string"), "u7", 7)
    category = F.when(k % 3 == 0, "malicious").when(k % 3 == 1, "impersonation").otherwise("else")
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", labels.event_type(threat).alias("kind"), labels.severity(threat).alias("severity"), labels.risk_level(x).alias("risk"), labels.similarity_text(x).alias("similarity"),
        F.round(labels.eta_seconds(k % 120, k % 50, state), 6).alias("eta"), editable.alias("editable"), labels.mapped(state, labels.TRAINING_STATUS).alias("training"), labels.category_label(category).alias("category"),
    )


@query("""
SELECT event_id, CAST(ts AS DATE) AS slash, CAST(ts AS DATE) AS anyhow, CAST(ts AS DATE) AS certificate, CAST(ts AS DATE) AS iso, CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_day, CAST(hour(ts + INTERVAL 8 HOUR) AS INT) AS local_hour FROM events
""")
def date_texts(spark, sf_dir):
    """Dates from the texts that sources write, and local times."""
    ts = F.col("ts")
    of = lambda f: F.date_format(ts, f)
    k = F.col("event_id") % 6
    anyhow = F.when(k == 0, of("y-M-d")).when(k == 1, of("y/MM/d")).when(k == 2, of("y-M-d H:m:s")).when(k == 3, of("y/M/d HH:mm:ss")).when(k == 4, of("d-MMM-y")).otherwise(of("yyyy-MM-dd'T'HH:mm:ss"))
    local = cleaning.local_time(ts)
    return _t(spark, sf_dir, "events").select(
        "event_id", cleaning.slash_date(of("y/M/d")).alias("slash"), cleaning.any_date(anyhow).alias("anyhow"), cleaning.certificate_time(F.concat(of("MMM  d HH:mm:ss yyyy"), F.lit(" GMT"))).cast("date").alias("certificate"),
        cleaning.iso_day(F.concat(of("yyyy-MM-dd"), F.lit("T23:30:00+08:00"))).alias("iso"), F.to_date(local).alias("local_day"), F.hour(local).alias("local_hour"),
    )


@query("""SELECT o_orderkey, '{"k":' || o_orderkey || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","price":' || CAST(o_totalprice AS DECIMAL(12, 2)) || ',"parts":["' || o_orderstatus || '","x"]}' AS body FROM orders""")
def plain_values(spark, sf_dir):
    """Nested values as plain JSON."""
    body = F.struct(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.array("o_orderstatus", F.lit("x")).alias("parts"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", cleaning.plain(body).alias("body"))


@query(r"""
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name || '-' || p_brand || '_9 ' || p_type), '[-_.0-9\s]+'), lambda x: x <> ''), ' ') AS tokens, p_name || '域名' AS term,
  CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS first_name, regexp_full_match(lower(p_name || '.com'), '([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}') AS valid FROM part
""")
def text_terms(spark, sf_dir):
    """Tokens of texts, usual terms, the first key that is there, and what has the form of a domain."""
    record = F.to_json(F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("name"), F.col("p_type").alias("title")))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(names.text_tokens(F.concat("p_name", F.lit("-"), "p_brand", F.lit("_9 "), "p_type")), " ").alias("tokens"), labels.usual_terms(F.concat("p_name", F.lit("码址"))).alias("term"),
        labels.first_key(record, "none", "name", "title").alias("first_name"), names.valid_domain(F.concat("p_name", F.lit(".com"))).alias("valid"),
    )


@query("""
SELECT p_partkey, CASE WHEN a = '' AND p_partkey % 3 > 0 AND b = '' THEN 'none' ELSE array_to_string(list_filter([CASE WHEN a <> '' THEN '与历史 IOC 域名 ' || a || ' 具备相似特征' END, CASE WHEN p_partkey % 3 = 0 THEN 'TLD 或结构模式相似' END, CASE WHEN b <> '' THEN '关键词重叠: ' || b END], lambda x: x IS NOT NULL), '|') END AS lines
FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS a, CASE WHEN p_partkey % 5 = 0 THEN p_brand || ', ' || p_type ELSE '' END AS b FROM part)
""")
def evidence_texts(spark, sf_dir):
    k = F.col("p_partkey")
    words = F.when(k % 5 == 0, F.array(F.concat(F.lit(" "), "p_brand"), F.lit(" "), "p_type")).otherwise(F.array().cast("array<string>"))
    lines = labels.evidence_lines(F.when(k % 2 == 0, F.col("p_name")).otherwise(""), k % 3 == 0, words, F.lit("none"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(lines, "|").alias("lines"))


@query("""
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'v' || c_custkey WHEN 1 THEN 'apt_org:20240105103000' WHEN 2 THEN 'apt_org:20240301' ELSE 'actor_profile_v1' END AS version, 'mixed' AS consensus FROM customer
""")
def profile_versions(spark, sf_dir):
    """The version of each profile, and that of all together."""
    k = F.col("c_custkey")
    version = labels.profile_version(F.when(k % 4 == 0, F.concat(F.lit(" v"), k)).otherwise(" "), F.when(k % 4 == 1, F.lit("2024-01-05 10:30:00").cast("timestamp")), F.when(k % 4 == 2, F.lit("2024-03-01").cast("date")))
    profs = _t(spark, sf_dir, "customer").select(k.alias("organization_id"), version.alias("version"))
    return profs.join(F.broadcast(attribution.version_of(profs.select("organization_id"), profs).withColumnRenamed("version", "consensus"))).select(F.col("organization_id").alias("id"), "version", "consensus")


_NOTICE = """
WITH o AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN '未知' ELSE c_mktsegment END AS org, c_name, row_number() OVER (PARTITION BY CASE WHEN c_custkey % 11 = 0 THEN '未知' ELSE c_mktsegment END ORDER BY lower(c_name)) AS k FROM customer),
g AS (SELECT org, count(*) AS n, '【' || org || '】(' || count(*) || '个)' || chr(10) || string_agg(k || '. ' || c_name, chr(10) ORDER BY k) AS s FROM o GROUP BY org)
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE org <> '未知') AS BIGINT) AS known, '本批次高风险域名数量：' || CAST(sum(n) AS BIGINT) || chr(10) || '已形成组织关联的域名数量：' || CAST(sum(n) FILTER (WHERE org <> '未知') AS BIGINT) || chr(10) || chr(10)
  || string_agg(s, chr(10) || chr(10) ORDER BY org = '未知', lower(org)) AS text FROM g
"""


@query(_NOTICE)
def notice(spark, sf_dir):
    """The text of a notice, by organization, the unknown one last."""
    m = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("domain"), F.when(F.col("c_custkey") % 11 == 0, " ").otherwise(F.col("c_mktsegment")).alias("organization_name"))
    return attribution.notice_text(attribution.by_organization(m)).select("total", "known", "text")


@query(f"SELECT line, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text || chr(10), chr(10))[:-2]) AS line FROM ({_NOTICE})) GROUP BY line")
def notice_file(spark, sf_dir):
    """The lines of the notice as a file, written by ranges."""
    m = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("domain"), F.when(F.col("c_custkey") % 11 == 0, " ").otherwise(F.col("c_mktsegment")).alias("organization_name"))
    path = f"{scratch(spark, 'files')}/notice.txt"
    attribution.write_notice(m, path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


# Archives, filters, previews -------------------------------------------------------------------------------


@query(r"""
WITH h AS (SELECT page_id % 37 AS k, regexp_extract(lower(trim(url)), '^(?:[a-z]+://)?([^/?#:]*)', 1) AS host FROM pages WHERE url IS NOT NULL)
SELECT k AS archive, host, CAST(count(*) * CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n, CAST(length(host) - length(replace(host, '-', '')) AS DOUBLE) AS hyphens, CAST(len(regexp_split_to_array(host, '[-._]')) AS DOUBLE) AS parts FROM h WHERE host <> '' GROUP BY k, host
""")
def traversed_archives(spark, sf_dir):
    """Archives of hosts in folders, some within others, some twice; the second half comes after the first was read."""
    root, cache = scratch(spark, "archives"), f"{scratch(spark, 'features')}/cache"
    h = _t(spark, sf_dir, "pages").where("url IS NOT NULL").select((F.col("page_id") % 37).alias("k"), names.normal_domain(F.col("url")).alias("host")).where("host <> ''")
    for half in range(2):
        _archives(h.where(F.col("k") % 2 == half), root)
        out = archives.traverse(spark, root, cache)
    k = F.regexp_extract("path", r"list-(\d+)", 1).cast("long").alias("archive")
    return out.groupBy(k, F.col("domain").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.max("hyphens").alias("hyphens"), F.max("parts").alias("parts"))


def _archives(rows, root: str) -> None:
    """One archive for each k of (k, host), every third within another, every fifth twice under two names."""

    def write(group: pa.Table) -> pa.Table:
        import pyarrow.fs as pafs

        k = group["k"][0].as_py()
        data = _zipped("\n".join(["", *group["host"].to_pylist()]).encode())
        if k % 3 == 0:
            outer = io.BytesIO()
            with zipfile.ZipFile(outer, "w") as z:
                z.writestr("in/inner.zip", data)
                z.writestr("readme.txt", "no list")
            data = outer.getvalue()
        fs, inner = pafs.FileSystem.from_uri(root)
        for n in range(2 if k % 5 == 0 else 1):
            fs.create_dir(f"{inner}/{k % 4}/{n}")
            with fs.open_output_stream(f"{inner}/{k % 4}/{n}/list-{k}.zip", compression=None) as f:
                f.write(data)
        return pa.table({"n": [group.num_rows]})

    rows.orderBy("host").groupBy("k").applyInArrow(write, "n long").agg(F.sum("n")).collect()


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' AND (contains(lower(p_name), 'al') OR contains(lower(p_type), 'al'))")
def client_models(spark, sf_dir):
    """Models of a source whose name or description has a keyword."""
    test = client.task_filter(kind="Brand#13", keyword=" AL ", kind_col="p_brand", texts=("p_name", "p_type"))
    return _t(spark, sf_dir, "part").where(test).select("p_partkey")


@query("SELECT event_id FROM events WHERE user_id = 17 UNION ALL SELECT event_id FROM events WHERE event_type = 'error'")
def client_equalities(spark, sf_dir):
    """Events of an organization, and alerts of a model."""
    e = _t(spark, sf_dir, "events")
    of = lambda c, v: e.where(client.task_filter(kind=v, kind_col=c)).select("event_id")
    return of("user_id", 17).unionByName(of("event_type", "error"))


@query("SELECT p_name || p_partkey AS domain, CAST(p_partkey % 2 AS INT) AS label FROM part ORDER BY p_partkey LIMIT 5")
def training_preview(spark, sf_dir):
    """The first rows of a training list, one file in the order of its lines."""
    k = F.col("p_partkey")
    lines = in_order(_t(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", k, F.lit(","), k % 2).alias("line")), ["p_partkey"], "at")
    path = f"{scratch(spark, 'files')}/training.csv"
    write_stitched(lines, ["at"], path, head="no label\nx,7\n")
    return files.preview(files.training_list(spark, path))


@query("SELECT id, CAST(row_number() OVER (ORDER BY t, n, id) AS INT) AS place FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS t, l_linestatus AS n FROM lineitem WHERE l_partkey = 7)")
def records_in_order(spark, sf_dir):
    """The DNS records of a domain by type, then name."""
    d = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("d"), "p_partkey").alias("domain_name"), F.lit(1).alias("organization_id"))
    none = spark.createDataFrame([], "id long, domain_id long, name string, query_time date, created_at date")
    dns = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("domain_id"), F.col("l_returnflag").alias("record_type"), F.col("l_linestatus").alias("record_name"))
    sorted_rows = entities.domain_detail(d, "D7", none.select("id", "name"), none, dns, none)["dns"].withColumn("row", F.monotonically_increasing_id())
    return sorted_rows.select("id", F.row_number().over(Window.orderBy("row")).alias("place"))


@query("""
SELECT p_name || p_partkey AS domain, CAST(p_size AS VARCHAR) AS similarity, 'all' AS sheet FROM part UNION ALL SELECT p_name || p_partkey, CAST(p_size AS VARCHAR), 'positive' FROM part WHERE p_size > 25
UNION ALL SELECT 'total', CAST(count(*) AS VARCHAR), 'statistics' FROM part
""")
def lookalike_book(spark, sf_dir):
    """The workbook of a look-alike detection, with its own names of sheets, written and read back."""
    rows = _t(spark, sf_dir, "part").select(F.concat("p_name", "p_partkey").alias("domain"), F.col("p_size").alias("similarity"))
    path = f"{scratch(spark, 'files')}/lookalikes.xlsx"
    statistics = rows.agg(F.count(F.lit(1)).alias("similarity")).select(F.lit("total").alias("domain"), "similarity")
    xlsx.write_result_book(path, rows, statistics, rows.where("similarity > 25"), "impersonation")
    sheets = {"检测结果": "all", "钓鱼域名列表": "positive", "统计信息": "statistics"}
    out = [xlsx.read_xlsx(spark, path, sheet).select("domain", "similarity", F.lit(name).alias("sheet")) for sheet, name in sheets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""
WITH e AS (SELECT DISTINCT {_FEED} AS domain, CAST(ts AS DATE) + 250 AS day FROM events), d AS (SELECT CAST(d AS DATE) AS d FROM generate_series(TIMESTAMP '2024-09-20', TIMESTAMP '2024-10-20', INTERVAL 1 DAY) AS g(d))
SELECT DISTINCT domain, 'read' AS status FROM e WHERE day IN (SELECT d FROM d) UNION ALL SELECT CAST(d AS VARCHAR), 'missing' FROM d WHERE d NOT IN (SELECT day FROM e)
""")
def daily_feed_strict(spark, sf_dir):
    """The longest range that a user may ask for."""
    root = scratch(spark, "feed")
    e = _t(spark, sf_dir, "events").select(F.date_add(F.to_date("ts"), 250).alias("day"), F.concat(F.lower("event_type"), F.col("user_id") % 700, F.lit(".example.com")).alias("domain"))
    _daily_files(e, lambda day: day_path(root, day), _zipped)
    found, gone = daily_feed(spark, root, "2024-09-20", "2024-10-20", strict=True)
    return found.select("domain", F.lit("read").alias("status")).unionByName(gone.select(_s("day").alias("domain"), "status"))


# Catalog, matches, details ---------------------------------------------------------------------------------


@query("""
SELECT 'dns' AS kind, l_orderkey * 10 + l_linenumber AS id, l_returnflag AS what FROM lineitem WHERE l_partkey = 7
UNION ALL SELECT 'domain', p_partkey, n_name FROM part LEFT JOIN nation ON p_size % 30 = n_nationkey WHERE p_partkey = 7
UNION ALL (SELECT 'whois', o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
UNION ALL (SELECT 'certificate', event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1)
""")
def domain_records(spark, sf_dir):
    """What is known of one domain: its row, DNS records, the latest WHOIS and certificate."""
    d = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("D"), "p_partkey", F.lit(".com")).alias("domain_name"), (F.col("p_size") % 30).alias("organization_id"))
    orgs = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    whois = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("domain_id"), F.col("o_orderdate").alias("query_time"), F.col("o_orderstatus").alias("what"))
    dns = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("domain_id"), F.col("l_returnflag").alias("record_type"), F.col("l_linestatus").alias("record_name"))
    certificates = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("domain_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("what"))
    found = entities.domain_detail(d, " d7.COM", orgs, whois, dns, certificates)
    out = None
    for kind, what in (("dns", "record_type"), ("domain", "organization"), ("whois", "what"), ("certificate", "what")):
        part = found[kind].select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.col(what).alias("what"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT l_orderkey * 10 + l_linenumber AS id, p_name, CASE l_returnflag WHEN 'A' THEN 'official' WHEN 'R' THEN 'market' ELSE 'custom' END AS source FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 7 AND l_linestatus = 'O'
""")
def models_of_user(spark, sf_dir):
    source = F.when(F.col("l_returnflag") == "A", "official").when(F.col("l_returnflag") == "R", "market").otherwise("custom")
    links = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("model_id"), source.alias("source"), (F.col("l_linestatus") == "O").alias("is_active"), F.col("l_shipdate").alias("acquired_at"))
    return catalog.models_of(links, _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name"), 7).select("id", "p_name", "source")


@query("""
WITH u AS (SELECT s_suppkey % 10 AS user_id, s_suppkey AS model_id, CASE s_suppkey % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'market' ELSE 'custom' END AS source FROM supplier)
SELECT 'link' AS kind, user_id, model_id, source AS state, NOT (user_id = 5 AND model_id = 5) AS flag FROM u WHERE NOT (user_id = 4 AND model_id = 4) AND model_id <> 9
UNION ALL SELECT 'link', 5, s_suppkey, 'market', TRUE FROM supplier WHERE s_suppkey = 8
UNION ALL SELECT 'link', 2, s_suppkey, 'official', TRUE FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey NOT IN (SELECT model_id FROM u WHERE user_id = 2)
UNION ALL SELECT 'model', NULL, s_suppkey, CASE WHEN s_suppkey = 9 THEN 'deleted' ELSE 'active' END, s_suppkey % 2 = 0 OR s_suppkey = 7 FROM supplier
""")
def links_changed(spark, sf_dir):
    """Links and models after a removal, a deactivation, an acquisition, a publication, a soft delete and a seed of official models."""
    k = F.col("s_suppkey")
    s = _t(spark, sf_dir, "supplier")
    when = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    links = s.select(k.alias("id"), (k % 10).alias("user_id"), k.alias("model_id"), F.when(k % 3 == 0, "official").when(k % 3 == 1, "market").otherwise("custom").alias("source"), when.alias("acquired_at"), F.lit(True).alias("is_active"))
    models = s.select(k.alias("id"), F.when(k % 5 == 0, "official").otherwise("custom").alias("model_type"), F.lit("active").alias("status"), (k % 2 == 0).alias("is_public"), F.concat(F.lit("u"), k).alias("created_by"))
    links = catalog.remove(catalog.remove(links, 4, 4), 5, 5)
    links = catalog.acquire(links, models, 5, 8, when)
    users = s.where("s_suppkey < 10").select(k.alias("id"), F.concat(F.lit("u"), k).alias("username"))
    links = catalog.seed_links(links, users, models, "u2", when)
    models = catalog.publish(catalog.publish(models, 7, "u7"), 3, "u4")
    models, links = catalog.soft_delete(models, links, 9)
    one = links.select(F.lit("link").alias("kind"), "user_id", "model_id", F.col("source").alias("state"), F.col("is_active").alias("flag"))
    return one.unionByName(models.select(F.lit("model").alias("kind"), F.lit(None).cast("long").alias("user_id"), F.col("id").alias("model_id"), F.col("status").alias("state"), F.col("is_public").alias("flag")))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 100 = 3 AND o_orderkey = 3 THEN 'confirmed' ELSE 'pending' END AS status FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 AND lower(o_orderpriority) LIKE '%high%'
UNION ALL SELECT o_orderkey, 'confirmed' FROM orders WHERE o_orderkey = 3
""")
def matches_of_user(spark, sf_dir):
    """The matches of a user's alerts that a search finds, and one that was marked."""
    m = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("alert_id"), F.col("o_orderpriority").alias("domain_name"), F.col("o_orderstatus").alias("organization_name"), F.col("o_totalprice").alias("actor_score"), F.col("o_orderdate").alias("created_at"), F.lit("low").alias("confidence"), F.lit("pending").alias("status"))
    alerts = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("alert_id"), F.col("c_nationkey").alias("user_id"))
    marked = housekeeping.mark_match(m, 3, " Confirmed ")
    found = housekeeping.match_search(housekeeping.owned_matches(marked, alerts, 7), domain=" HIGH ", confidence="low")
    return found.select("id", "status").unionByName(marked.where("status = 'confirmed'").select("id", "status"))


@query("SELECT 'k' || p_partkey AS key FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 5 > 0")
def unknown_objects(spark, sf_dir):
    """Stored objects that neither a file nor a task names."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("k"), "p_partkey").alias("key"))
    tasks = p.where("p_partkey % 5 = 0").select(F.to_json(F.struct(F.col("key").alias("result_file_key"))).alias("extra"))
    return housekeeping.unknown_objects(p.select("key"), p.where("p_partkey % 3 = 0").select(F.col("key").alias("object_key")), tasks)


@query("""
SELECT 'alert' AS kind, o_orderkey AS alert_id, NULL AS domains FROM orders WHERE o_orderkey % 10 > 0 UNION ALL SELECT 'detail', o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 > 0
""")
def alerts_moved(spark, sf_dir):
    """Alerts without a bulky column, their side table, and both without what was dropped."""
    a = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("alert_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("high_risk_domains"))
    rest, details = housekeeping.move_details(a)
    none = a.limit(0).select("alert_id")
    left = housekeeping.drop_alerts(rest, F.col("alert_id") % 10 == 0, none, none, details)
    return left["alerts"].select(F.lit("alert").alias("kind"), "alert_id", F.lit(None).cast("string").alias("domains")).unionByName(left["alert_details"].select(F.lit("detail").alias("kind"), "alert_id", F.col("high_risk_domains").alias("domains")))


@query("""
SELECT p_name || p_partkey AS domain_name, CASE WHEN p_partkey % 4 = 0 THEN 'stored' ELSE 'pending' END AS status, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 3 = 0 THEN p_partkey END AS domain_id, CASE WHEN p_partkey % 4 > 0 THEN (p_size % 10) / 10.0::DOUBLE END AS score FROM part
""")
def matches_stored(spark, sf_dir):
    """Matches added to those that are there, which stay as they are."""
    p = _t(spark, sf_dir, "part")
    name = F.concat("p_name", "p_partkey")
    m = p.select(name.alias("domain"), F.col("p_size").alias("organization_id"), F.col("p_brand").alias("organization_name"), ((F.col("p_size") % 10) / 10.0).alias("actor_score"), F.lit("low").alias("confidence"), F.struct(F.lit(1).alias("a")).alias("evidence"), F.array(F.struct(F.lit(1).alias("a"))).alias("top_candidates"))
    d = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.upper(name).alias("domain_name"))
    empty = attribution.persist_matches(_no_matches(spark), m.limit(0), d, "a1", F.lit("2024-01-05").cast("date"))
    there = p.where("p_partkey % 4 = 0").select(F.lit("a1").alias("alert_id"), name.alias("domain_name"), F.lit("stored").alias("status"))
    stored = empty.unionByName(files.with_columns(there, **{c: t for c, t in empty.dtypes}).select(*empty.columns))
    return attribution.persist_matches(stored, m, d, "a1", F.lit("2024-01-05").cast("date")).select("domain_name", "status", "domain_id", F.col("actor_score").cast("double").alias("score"))


def _no_matches(spark):
    from .schemas import schema

    return spark.createDataFrame([], schema("alert_domain_matches"))


@query("SELECT event_id, ts FROM events WHERE user_id = 7 ORDER BY CAST(ts AS DATE) DESC, event_id DESC LIMIT 50")
def recent_events(spark, sf_dir):
    """An organization's latest 50 events."""
    e = _t(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("event_date"), F.col("user_id").alias("organization_id"), F.col("event_id").alias("id"))
    _, latest = entities.organization_detail(_t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id"), e, 7)
    return latest.select("event_id", "ts")


@query("SELECT event_id, event_type = 'error' AS malicious FROM events ORDER BY event_type = 'error' DESC, ts DESC, event_id DESC LIMIT 30 OFFSET 30")
def malicious_first(spark, sf_dir):
    """The second page of 30, malicious ones first, then newest."""
    e = _t(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_type") == "error").alias("malicious"))
    return page(e, [F.desc("malicious"), F.desc("ts"), F.desc("event_id")], 2, 30).select("event_id", "malicious")


@query("SELECT p_partkey, p_type FROM part WHERE p_type IS NULL OR p_type NOT IN ('ECONOMY', 'SMALL')")
def market_models(spark, sf_dir):
    """Models of the category other, in order of their names."""
    return client.by_name(_t(spark, sf_dir, "part").where(client.market_filter("other", "p_type", ("ECONOMY", "SMALL"))), "p_name", "p_partkey").select("p_partkey", "p_type")


@query("""
SELECT lower(trim(p_name)) AS target, max_by(p_brand, p_partkey) AS company, min(p_partkey) AS ord, CASE WHEN length(replace(lower(trim(p_name)), '.', '')) <= 4 THEN 0.92::DOUBLE WHEN length(replace(lower(trim(p_name)), '.', '')) <= 6 THEN 0.88 ELSE 0.85 END AS bound FROM part GROUP BY 1
""")
def official_names(spark, sf_dir):
    """Official names once, with the last company and the first place, and the similarity that look-alikes have to exceed."""
    o = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("company"), F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("domain"), F.col("p_partkey").alias("position"))
    return lookalike.official_targets(o).withColumn("bound", names.similarity_bound(names.key_domain(F.col("target"))).cast("double"))


@query("""
SELECT 'malicious' AS kind, CAST(event_id AS VARCHAR) AS name FROM events WHERE value > 60 UNION ALL SELECT DISTINCT 'look-alike', event_type FROM events WHERE event_type IS NOT NULL
""")
def positive_rows(spark, sf_dir):
    """Malicious rows, and the names of a look-alike alert; statistics without any give no names."""
    e = _t(spark, sf_dir, "events")
    one = detection.malicious_only(e.withColumn("predicted", (F.col("value") > 60).cast("int"))).select(F.lit("malicious").alias("kind"), _s("event_id").alias("name"))
    stats = e.agg(F.count(F.lit(1)).alias("phishing"))
    some = detection.look_alike_alert_rows(e.select(F.col("event_type").alias("domain")), stats)
    none = detection.look_alike_alert_rows(e.select(F.col("event_type").alias("domain")), stats.withColumn("phishing", F.lit(0)))
    return one.unionByName(some.unionByName(none).select(F.lit("look-alike").alias("kind"), F.col("domain").alias("name")))
