"""The engine's operators on the driver's tables, each with SQL that gives the same rows.

The tables hold no threat data, so others play their part: events are the events, customers the organizations,
nations and regions the places, orders the tasks, parts the models, hosts of pages the domains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import labels, lexical, names
from .functions.cleaning import any_list, mixed_date, percent_text, pipe_list, relative_time, to_int
from .operators import attribution, catalog, client, detection, entities, forest, housekeeping, lookalike, similar_sets, situation
from .plans.relational import in_order, insert_missing, latest_by_key, missing_from, numbered, page, top_by_key, update_from, with_fallback
from .registry import ORACLE_SQL, QUERIES, query
from .registry import table as _t
from .session import scratch, stored
from . import queries_files  # noqa: F401  registers its queries

AS_OF = "2024-01-31"
def _as_of():
    return F.lit(AS_OF).cast("date")


def _day(c: str = "ts"):
    return F.to_date(c)


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# Situation -------------------------------------------------------------------------------------------------


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS count FROM events WHERE event_type IS NOT NULL AND event_type <> '' GROUP BY event_type")
def region_distribution(spark, sf_dir):
    return situation.count_by(_t(spark, sf_dir, "events"), "event_type")


@query(f"""
SELECT (SELECT count(*) FROM customer) AS total_organizations, (SELECT count(*) FROM events) AS total_events, (SELECT count(*) FROM part) AS total_domains,
  (SELECT count(DISTINCT user_id) FROM events WHERE CAST(ts AS DATE) >= DATE '{AS_OF}' - 7) AS active_threats,
  (SELECT count(*) FROM events WHERE CAST(ts AS DATE) >= DATE '{AS_OF}' - 7) AS new_threats, (SELECT count(*) FROM part) AS total_iocs,
  CAST(floor((SELECT count(*) FROM events) * 0.25::DOUBLE) AS BIGINT) AS share_a, CAST(floor((SELECT count(*) FROM events) * 0.3::DOUBLE) AS BIGINT) AS share_b
""")
def summary_counts(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select(_day().alias("event_date"), F.col("user_id").alias("organization_id"))
    one = situation.totals(_t(spark, sf_dir, "customer"), events, _t(spark, sf_dir, "part"), _as_of())
    return one.select("*", *situation.shares(F.col("total_events"), [("share_a", 0.25), ("share_b", 0.3)]))


@query(f"""
SELECT (SELECT count(*) FROM customer) AS total_organizations, (SELECT count(*) FROM events) AS total_events, (SELECT count(*) FROM part) AS total_domains,
  (SELECT CAST(coalesce(sum(CAST(floor(c_acctbal) AS BIGINT)), 0) AS BIGINT) FROM customer) AS total_iocs,
  (SELECT count(DISTINCT user_id) FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 7) AS active_threats,
  (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-30') AS new_threats
""")
def snapshot_row(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select(_day().alias("event_date"), F.col("user_id").alias("organization_id"))
    orgs = _t(spark, sf_dir, "customer").select(F.floor("c_acctbal").cast("long").alias("iocs"))
    return situation.totals(orgs, events, _t(spark, sf_dir, "part"), F.lit("2024-01-30").cast("date"), iocs="iocs")


@query("""
SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  CAST(sum(CASE WHEN event_type LIKE '%click%' THEN 1 ELSE 0 END) AS BIGINT) AS clicks FROM events GROUP BY 1
""")
def trend_daily(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return situation.daily_counts(e, _day(), errors=F.col("event_type") == "error", clicks=F.col("event_type").contains("click"))


@query(f"""
SELECT CAST(ts AS DATE) AS trend_date, 0::BIGINT AS dns_tunnel_count, 0::BIGINT AS dga_domain_count, 0::BIGINT AS phishing_count, 0::BIGINT AS c2_communication_count,
  CAST(count(*) AS BIGINT) AS malware_count FROM events WHERE CAST(ts AS DATE) >= DATE '{AS_OF}' - 30 GROUP BY 1
""")
def trend_fallback(spark, sf_dir):
    """The prepared table is empty, so the events are counted."""
    e = _t(spark, sf_dir, "events").withColumn("event_date", _day())
    prepared = spark.createDataFrame([], "trend_date date, dns_tunnel_count long, dga_domain_count long, phishing_count long, c2_communication_count long, malware_count long")
    return situation.trends(prepared, e, "event_date", F.date_sub(_as_of(), 30))


@query("""
SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1
""")
def prepared_first(spark, sf_dir):
    """The prepared counts have rows, so the fallback adds none."""
    o = _t(spark, sf_dir, "orders")
    prepared = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return with_fallback(prepared, o.select(F.col("o_orderstatus").alias("status"), F.lit(1).cast("long").alias("n")))


@query("SELECT c_custkey, c_name, c_acctbal, c_acctbal AS measure FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_entities(spark, sf_dir):
    return situation.top_entities(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", "no_such_column", ["c_acctbal"], 10)


@query("SELECT CAST(ts AS DATE) AS day, event_type AS region, CAST(count(*) AS BIGINT) AS count FROM events WHERE event_type IS NOT NULL GROUP BY ALL")
def heatmap_day_type(spark, sf_dir):
    return situation.heat_map(_t(spark, sf_dir, "events"), _day(), "event_type")


@query("""
SELECT CASE WHEN n_name LIKE '%1%' THEN n_name ELSE '未知' END AS origin, CAST(count(*) AS BIGINT) AS count FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def origin_counts(spark, sf_dir):
    joined = entities.with_organization(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", place="n_name")
    return situation.origin_counts(joined, F.when(F.col("place").contains("1"), F.col("place")).otherwise(" "))


@query("""
SELECT CAST(ts AS DATE) AS day, coalesce(c_mktsegment, '未知') AS region, CAST(count(*) AS BIGINT) AS event_count, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS major_count
FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY ALL
""")
def region_day_rollup(spark, sf_dir):
    return situation.region_day_rollup(_t(spark, sf_dir, "events"), _t(spark, sf_dir, "customer"), _day(), "user_id", "c_custkey", "c_mktsegment", F.col("event_type") == "error")


# Entities --------------------------------------------------------------------------------------------------


@query("""
SELECT event_id, ts, event_type, value, c_name AS organization FROM (
  SELECT * FROM events WHERE event_type = 'error' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20)
LEFT JOIN customer ON user_id = c_custkey
""")
def events_page(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    where = (F.col("event_type") == "error") & _day().between(F.lit("2024-01-05"), F.lit("2024-01-25"))
    rows = entities.events_page(e, _t(spark, sf_dir, "customer"), where, "user_id", "c_custkey", "c_name", "ts", "event_id", 2, 20)
    return rows.select("event_id", "ts", "event_type", "value", "organization")


@query("SELECT CAST(count(*) AS BIGINT) AS total FROM events WHERE event_type = 'error'")
def events_total(spark, sf_dir):
    return entities.total(_t(spark, sf_dir, "events"), F.col("event_type") == "error")


@query(f"""
SELECT event_id, value, c_name AS organization FROM events LEFT JOIN customer ON user_id = c_custkey
WHERE value IS NOT NULL AND props IS NOT NULL AND CAST(ts AS DATE) >= DATE '{AS_OF}' - 30
""")
def map_points_recent(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("day", _day())
    return entities.map_points(e, _t(spark, sf_dir, "customer"), "user_id", "c_custkey", "c_name", "day", F.date_sub(_as_of(), 30), ["value", "props"]).select("event_id", "value", "organization")


@query("""
SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE (lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%') AND p_size >= 5 ORDER BY p_size DESC, p_partkey DESC LIMIT 25
""")
def profile_search(spark, sf_dir):
    rows = entities.search(_t(spark, sf_dir, "part"), " RING ", ["p_name", "p_brand"], F.col("p_size") >= 5)
    return page(rows.select("p_partkey", "p_name", "p_brand", "p_size"), [F.desc("p_size"), F.desc("p_partkey")], 1, 25)


@query("""
SELECT p_partkey, n_lines FROM (SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n_lines FROM part)
""")
def entity_attribute_counts(spark, sf_dir):
    counted = entities.attribute_counts(_t(spark, sf_dir, "part").select("p_partkey"), "p_partkey", {"n_lines": (_t(spark, sf_dir, "lineitem"), "l_partkey")})
    return counted


@query("""
SELECT c_custkey, n_orders, n_events, n_links FROM (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_events,
  (SELECT count(*) FROM supplier WHERE s_suppkey = c_custkey) AS n_links FROM customer) WHERE n_orders = 0 OR n_events = 0 OR n_links = 0
""")
def entities_lacking(spark, sf_dir):
    children = {"n_orders": (_t(spark, sf_dir, "orders"), "o_custkey"), "n_events": (_t(spark, sf_dir, "events"), "user_id"), "n_links": (_t(spark, sf_dir, "supplier"), "s_suppkey")}
    counted = entities.attribute_counts(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", children)
    return entities.lacking(counted, list(children))


@query("""
SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1
""")
def latest_per_entity(spark, sf_dir):
    return latest_by_key(_t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], "ts", "event_id")


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN json_valid(props) THEN NULL ELSE props END AS props_raw FROM events
""")
def json_props(spark, sf_dir):
    return entities.json_field(_t(spark, sf_dir, "events").select("event_id", "props"), "props", "k int", "parsed").select("event_id", F.col("parsed.k").alias("k"), F.col("parsed_raw").alias("props_raw"))


@query("""
SELECT o_orderkey, o_custkey, o_totalprice, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3
""")
def top_k_per_key(spark, sf_dir):
    return top_by_key(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


# Catalog and housekeeping ----------------------------------------------------------------------------------

_KEY = "CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 150 AS VARCHAR) WHEN p_partkey % 3 = 1 THEN 'Supplier#' || lpad(CAST(p_partkey % 120 AS VARCHAR), 9, '0') ELSE 'nobody' END"


@query(f"""
SELECT p_partkey, created_by, s_suppkey AS owner_id, s_name AS owner_name FROM (SELECT p_partkey, {_KEY} AS created_by FROM part)
LEFT JOIN supplier ON CASE WHEN regexp_full_match(created_by, '[0-9]+') THEN TRY_CAST(created_by AS BIGINT) = s_suppkey ELSE created_by = s_name END
""")
def polymorphic_join(spark, sf_dir):
    key = F.expr(_KEY.replace("VARCHAR", "string"))
    return catalog.by_id_or_name(_t(spark, sf_dir, "part").select("p_partkey", key.alias("created_by")), "created_by", _t(spark, sf_dir, "supplier"), "s_suppkey", "s_name")


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'R') AS added FROM part")
def catalog_added_flag(spark, sf_dir):
    where = (F.col("l_suppkey") == 7) & (F.col("l_returnflag") == "R")
    return catalog.with_added_flag(_t(spark, sf_dir, "part").select("p_partkey"), "p_partkey", _t(spark, sf_dir, "lineitem"), "l_partkey", where)


@query("""
SELECT p_partkey, p_type, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END AS place FROM part ORDER BY place, p_size DESC, p_partkey
""")
def ranked_sources(spark, sf_dir):
    place = labels.mapped(F.col("p_type"), {"ECONOMY": 1, "SMALL": 2, "MEDIUM": 3}, 4)
    return _t(spark, sf_dir, "part").withColumn("place", place).orderBy("place", F.desc("p_size"), "p_partkey").select("p_partkey", "p_type", "place")


@query("""
SELECT o_orderkey, c_name AS model_name, n_name AS file_name, CASE o_orderstatus WHEN 'pending' THEN '待执行' WHEN 'completed' THEN '已完成' ELSE o_orderstatus END AS status_label,
  CAST(CASE o_orderstatus WHEN 'completed' THEN 100 ELSE 0 END AS INT) AS progress
FROM (SELECT o_orderkey, o_custkey, o_custkey % 40 AS file_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE o_orderstatus END AS o_orderstatus FROM orders)
JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON file_id = n_nationkey
""")
def tasks_listing(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumns({"file": F.col("o_custkey") % 40, "state": F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise(F.col("o_orderstatus"))})
    names_ = {"task": "o_orderkey", "model": "o_custkey", "file": "file", "status": "state", "type": "o_orderpriority", "created": "o_orderdate", "model_id": "c_custkey", "model_name": "c_name", "file_id": "n_nationkey", "file_name": "n_name"}
    return catalog.task_listing(o, _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation"), names_).select("o_orderkey", "model_name", "file_name", "status_label", "progress")


@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL) AND c_custkey NOT IN (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)
""")
def orphans_not_in(spark, sf_dir):
    return missing_from(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", (_t(spark, sf_dir, "orders"), "o_custkey"), (_t(spark, sf_dir, "events"), "user_id"))


@query("""
SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)
""")
def seed_missing(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return insert_missing(s, _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), ["k"])


@query("""
SELECT c_custkey, c_mktsegment, coalesce(s_acctbal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
""")
def merge_update(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return update_from(c, _t(spark, sf_dir, "supplier"), F.expr("t.c_custkey = s.s_suppkey"), c_acctbal="s_acctbal")


@query("""
SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE text IS NULL OR length(text) < 20)
""")
def cascading_delete(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    from .plans.relational import delete_cascading

    gone = c.where(F.col("text").isNull() | (F.char_length("text") < 20))
    return delete_cascading(gone, "conv_id", {"turns": (c, "conv_id")})["turns"].select("conv_id", "turn")


@query("""
SELECT doc_id, lang, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, doc_id DESC) AS INT) AS place FROM (
  SELECT d.doc_id, lang, quality * 0.5::DOUBLE + toxic AS score FROM documents d LEFT JOIN labels USING (doc_id)) ORDER BY score DESC NULLS LAST, doc_id DESC LIMIT 30
""")
def match_search_order(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    m = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain_name"), (F.col("quality") * F.lit(0.5).cast("double") + F.col("toxic")).alias("actor_score"), F.lit(0).alias("created_at"))
    top = housekeeping.match_search(m).limit(30)  # the first page of the listing
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("actor_score"), F.desc("id")))  # of the 30 rows of a page
    return top.select(F.col("id").alias("doc_id"), F.col("domain_name").alias("lang"), F.col("actor_score").alias("score"), place.alias("place"))


# Listings that are shown -----------------------------------------------------------------------------------


@query("""
WITH k AS (SELECT *, coalesce(CAST(CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS VARCHAR), nullif(regexp_replace(lower(trim(event_type)), '[\\s_-]+', '', 'g'), ''), 'unknown') AS org_key FROM events)
SELECT org_key, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY org_key ORDER BY ts DESC, event_id DESC) AS r FROM k) WHERE r = 1
""")
def latest_event_per_org(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("org", F.when(F.col("event_type") != "view", F.col("user_id")))
    return client.latest_event_per_organization(e, "org", "event_type", "ts", "event_id").select("org_key", "event_id", "ts")


@query("""
SELECT CASE WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') THEN c_mktsegment ELSE '未知' END AS bucket, CAST(count(*) AS BIGINT) AS n, string_agg(c_name, ',' ORDER BY c_name) AS names FROM customer GROUP BY 1
""")
def bucketed_groups(spark, sf_dir):
    b = client.bucketed(_t(spark, sf_dir, "customer"), "c_mktsegment", ("FURNITURE", "MACHINERY"))
    return client.grouped_names(b, "bucket", "c_name").withColumn("names", F.array_join("names", ","))


@query("""
WITH x AS (SELECT CAST(date_trunc('month', min(o_orderdate)) - INTERVAL 1 MONTH AS DATE) AS f, last_day(CAST(max(o_orderdate) AS DATE)) AS e FROM orders),
r AS (SELECT f, CAST(e + INTERVAL 1 MONTH AS DATE) AS l, greatest(datediff('day', f, CAST(e + INTERVAL 1 MONTH AS DATE)), 1) AS days FROM x)
SELECT o_orderkey, greatest(0.0::DOUBLE, least(100.0::DOUBLE, datediff('day', f, CAST(o_orderdate AS DATE))::DOUBLE / days * 100)) AS position FROM orders, r
""")
def timeline_position(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return client.timeline_position(o, "day", client.timeline_range(o, "day")).select("o_orderkey", "position")


@query("""
WITH x AS (SELECT date_trunc('month', min(o_orderdate)) - INTERVAL 1 MONTH AS f, date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH AS l FROM orders)
SELECT CAST(unnest(generate_series(f, l, INTERVAL 1 MONTH)) AS DATE) AS month FROM x
""")
def timeline_months(spark, sf_dir):
    return client.timeline_months(client.timeline_range(_t(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")), "day"))


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE o_orderdate IS NOT NULL")
def distinct_years(spark, sf_dir):
    return client.distinct_years(_t(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT greatest(CAST(coalesce(max(length(trim(p_name))), 0) AS INT), 8) AS width FROM part")
def name_width(spark, sf_dir):
    return client.name_width(_t(spark, sf_dir, "part"), "p_name")


@query("SELECT CAST(count(*) FILTER (WHERE CAST(o_orderdate AS DATE) > DATE '2000-01-01') AS BIGINT) AS active FROM orders")
def active_since(spark, sf_dir):
    return client.active_since(_t(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), "day", "2000-01-01")


@query("""
SELECT n_name, coalesce(total, 0) AS total FROM nation LEFT JOIN (SELECT n_name, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 GROUP BY 1) USING (n_name)
""")
def label_totals(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    c = _t(spark, sf_dir, "customer").where("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return client.label_totals(c, n.select("n_name"), "n_name", "c_custkey")


@query("""
SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1) // 3 + 1 AS INT) AS page FROM orders
""")
def pages_within_key(spark, sf_dir):
    return client.pages_within(_t(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 3).select("o_orderkey", "page")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND lower(o_orderpriority) LIKE '%high%'
""")
def client_filters(spark, sf_dir):
    where = client.task_filter(status="O", first_day="1996-01-01", last_day="1996-12-31", keyword=" High ", created="o_orderdate", status_col="o_orderstatus", texts=("o_orderpriority",))
    return _t(spark, sf_dir, "orders").where(where).select("o_orderkey")


@query("""
WITH o AS (SELECT c_custkey AS id, regexp_replace(lower(c_name), '[\\s_#-]+', '', 'g') AS n FROM customer)
SELECT s_suppkey, (SELECT max(id) FROM o WHERE o.n = 'customer' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS resolved_id FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 2 = 1
""")
def resolve_organizations(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    e = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 1, F.col("s_suppkey")).alias("org"), F.concat(F.lit("CUSTOMER - "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("org_name"))
    o = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.replace("c_name", F.lit("#"), F.lit("_")).alias("name"), F.array(F.concat(F.lit("alias "), "c_name")).alias("alias"))
    return client.resolve_organization(e, "s_suppkey", "org", "org_name", o).select("s_suppkey", "resolved_id")


@query(f"""
SELECT event_id, CASE WHEN s >= 86400 THEN CAST(s // 86400 AS VARCHAR) || ' days ago' WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ' hours ago' WHEN s >= 60 THEN CAST(s // 60 AS VARCHAR) || ' minutes ago' ELSE 'just now' END AS ago
FROM (SELECT event_id, CAST(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts)) AS BIGINT) AS s FROM events)
""")
def relative_times(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", relative_time(F.col("ts"), F.lit(AS_OF).cast("timestamp")).alias("ago"))


# Cleaning --------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CAST(p_size AS INT) AS n, make_date(2024, CAST(p_partkey % 12 + 1 AS INT), CAST(p_partkey % 28 + 1 AS INT)) AS text_date, DATE '1899-12-30' + CAST(45000 + p_partkey % 500 AS INT) AS serial_date,
  array_to_string(string_split(p_name, ' '), ',') AS parts, array_to_string(string_split(p_name, ' '), ',') AS items FROM part
""")
def cleaning(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    month, day = (F.col("p_partkey") % 12 + 1).cast("string"), (F.col("p_partkey") % 28 + 1).cast("string")
    return p.select(
        "p_partkey",
        to_int(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("x"))).alias("n"),
        mixed_date(F.concat(F.lit("2024/"), month, F.lit("-"), day)).alias("text_date"),
        mixed_date(F.concat((F.lit(45000) + F.col("p_partkey") % 500).cast("string"), F.lit(".5"))).alias("serial_date"),
        F.array_join(pipe_list(F.replace("p_name", F.lit(" "), F.lit(" | "))), ",").alias("parts"),
        F.array_join(any_list(F.replace("p_name", F.lit(" "), F.lit(" ;, "))), ",").alias("items"),
    )


# Domain names ----------------------------------------------------------------------------------------------

_HOSTS = r"(SELECT DISTINCT regexp_extract(lower(trim(url)), '^(?:[a-z]+://)?([^/?#:]*)', 1) AS host FROM pages WHERE url IS NOT NULL)"


def _hosts(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "pages").where("url IS NOT NULL").select(names.normal_domain(F.col("url")).alias("host")).distinct()


@query(rf"""
SELECT host, coalesce(l[-2], '') AS sld, l[-1] AS tld, array_to_string(list_filter(regexp_split_to_array(host, '[-_.0-9]+'), lambda x: x <> ''), ' ') AS tokens FROM (SELECT host, string_split(host, '.') AS l FROM {_HOSTS})
""")
def host_normalise(spark, sf_dir):
    h = F.col("host")
    return _hosts(spark, sf_dir).select("host", names.sld(h).alias("sld"), names.tld(h).alias("tld"), F.array_join(names.domain_tokens(h), " ").alias("tokens"))


_LEX = rf"""
SELECT host, CAST(length(l[-2]) AS DOUBLE) AS sld_length, CAST(length(l[-1]) AS DOUBLE) AS tld_length, CAST(coalesce(list_sum(list_transform(l[:-3], lambda x: length(x))), 0) AS DOUBLE) AS rest_length,
  CAST(greatest(len(l) - 2, 0) AS DOUBLE) AS sub_labels,
  CAST(len(list_distinct(list_filter(list_transform(range(1, length(host)), lambda i: CASE WHEN host[i] = host[i + 1] THEN host[i] END), lambda x: x IS NOT NULL))) AS DOUBLE) AS doubled_chars,
  CAST(length(host) - length(replace(host, '-', '')) AS DOUBLE) AS hyphens,
  CAST(len(regexp_extract_all(array_to_string(l[:-2], '.'), '[0-9]')) AS DOUBLE) AS digits, CAST(len(regexp_extract_all(array_to_string(l[:-3], '.'), '[0-9]')) AS DOUBLE) AS rest_digits,
  CAST(l[-1] IN ('com', 'org', 'net', 'gov', 'edu') AS INT)::DOUBLE AS known_tld,
  CAST(len(p) AS DOUBLE) AS parts, list_avg(n) AS part_mean, CAST(list_max(n) AS DOUBLE) AS part_max, CAST(list_min(n) AS DOUBLE) AS part_min, list_stddev_pop(n) AS part_std,
  list_sum(list_transform(list_distinct(string_split(host, '')), lambda c: -((length(host) - length(replace(host, c, ''))) / length(host)) * log2((length(host) - length(replace(host, c, ''))) / length(host)))) AS entropy,
  CAST(len(list_filter(p[:-2], lambda x: contains(x, 'www'))) > 0 AS INT)::DOUBLE AS has_www, CAST(len(list_filter(p[:-2], lambda x: contains(x, 'com'))) > 0 AS INT)::DOUBLE AS has_com,
  CAST(coalesce(list_sum(list_transform(p[:-2], lambda x: len(regexp_extract_all(x, 'gov')))), 0) AS DOUBLE) AS gov_count
FROM (SELECT host, string_split(host, '.') AS l, regexp_split_to_array(host, '[-._]') AS p, list_transform(regexp_split_to_array(host, '[-._]'), lambda x: length(x)) AS n FROM {_HOSTS})
"""
_BARE = [n for n in lexical.NAMES if n not in ("edit_gov", "edit_pk", "edit_mail", "edit_serve", "words", "split_parts", "split_mean")]


@query("SELECT host, " + ", ".join(f"round({n}, 9) AS {n}" for n in _BARE) + f" FROM ({_LEX})")
def lexical_features(spark, sf_dir):
    return _hosts(spark, sf_dir).select("host", *lexical.features(F.col("host"))).select("host", *[F.round(n, 9).alias(n) for n in _BARE])


@query(rf"""
SELECT host, {", ".join(f"CAST(least(20, coalesce(list_min(list_transform(w, lambda x: levenshtein(x, '{k}'))), 20)) AS DOUBLE) AS edit_{k}" for k in lexical.EDIT_WORDS)}, CAST(len(s) + len(b) AS DOUBLE) AS words FROM (
  SELECT host, list_concat(p[:-2], b) AS w, list_filter(p, lambda x: length(x) <= 7) AS s, b FROM (
    SELECT host, p, list_filter(list_transform(list_filter(p, lambda x: length(x) > 7), lambda x: regexp_replace(x, '[0-9]+', '', 'g')), lambda x: x <> '') AS b
    FROM (SELECT host, regexp_split_to_array(host, '[-._]') AS p FROM {_HOSTS})))
""")
def keyword_edit_dist(spark, sf_dir):
    return _hosts(spark, sf_dir).select("host", *lexical.features(F.col("host"))).select("host", *[f"edit_{k}" for k in lexical.EDIT_WORDS], "words")


_GRAMS = "CASE WHEN length({0}) < 3 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) END"


@query(rf"""
WITH h AS (SELECT host, {_GRAMS.format("host")} AS g FROM {_HOSTS}),
p AS (SELECT a.host AS domain, b.host AS ioc, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS s FROM h a JOIN h b ON a.host <> b.host WHERE len(list_intersect(a.g, b.g)) > 0)
SELECT domain, ioc, round(s, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY s DESC, ioc) AS k FROM p) WHERE k = 1
""")
def ngram_jaccard_top(spark, sf_dir):
    h = _hosts(spark, sf_dir).select(F.col("host").alias("own"), names.char_grams(F.col("host")).alias("grams"))
    best = similar_sets.most_similar(h, h.select(F.col("own").alias("name"), F.col("own").alias("place"), "grams"), itself=False)
    return best.select(F.col("own").alias("domain"), F.col("name").alias("ioc"), F.round("score", 9).alias("score"))


_ANY = lambda words: "(" + " OR ".join(f"list_contains(t, '{w}')" for w in words) + ")"


@query(rf"""
SELECT doc_id, CASE WHEN {_ANY(names.SERVICE_WORDS)} AND {_ANY(names.LOGIN_WORDS)} AND {_ANY(names.SECURITY_WORDS)} THEN 0.9::DOUBLE WHEN {_ANY(names.SERVICE_WORDS)} AND {_ANY(names.LOGIN_WORDS)} AND {_ANY(names.UPDATE_WORDS)} THEN 0.85::DOUBLE
  WHEN {_ANY(names.LOGIN_WORDS)} AND {_ANY(names.SECURITY_WORDS)} THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM (SELECT doc_id, list_filter(regexp_split_to_array(CASE doc_id % 4 WHEN 0 THEN 'mail-login-verify' WHEN 1 THEN 'mail.login.update7' WHEN 2 THEN 'login_verify' ELSE 'login' END || '.' || lang, '[-_.0-9]+'), lambda x: x <> '') AS t FROM documents)
""")
def pattern_scores(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    name = F.element_at(F.array(*[F.lit(x) for x in ("mail-login-verify", "mail.login.update7", "login_verify", "login")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", names.pattern_score(names.domain_tokens(F.concat(name, F.lit("."), "lang"))).alias("score"))


# Attribution -----------------------------------------------------------------------------------------------

_PROFILES = "list_sort(list_distinct(list_filter({0}, lambda x: length(x) >= 3 AND x NOT IN ('com', 'net', 'org', 'www'))))"
_MATCH = rf"""
WITH h AS (SELECT host, string_split(host, '.') AS l, list_distinct(list_filter(regexp_split_to_array(host, '[-_.0-9]+'), lambda x: x <> '')) AS t, {_GRAMS.format("host")} AS g FROM {_HOSTS}),
o AS (SELECT page_id % 20 AS org, regexp_extract(lower(trim(url)), '^(?:[a-z]+://)?([^/?#:]*)', 1) AS ioc FROM pages WHERE url IS NOT NULL GROUP BY ALL),
og AS (SELECT org, ioc, {_GRAMS.format("ioc")} AS g, string_split(ioc, '.') AS l FROM o),
pr AS (SELECT org, 'Blog ' || CAST(org AS VARCHAR) AS name, {_PROFILES.format("flatten(list(regexp_split_to_array(array_to_string(l[:-2], '.'), '[-_.0-9]+')))")} AS kw, list_distinct(list(l[-1])) AS tlds FROM og GROUP BY org),
ioc AS (SELECT host, org, max(len(list_intersect(h.g, og.g)) / (len(h.g) + len(og.g) - len(list_intersect(h.g, og.g)))) AS s FROM h, og GROUP BY ALL),
sc AS (SELECT h.host AS domain, pr.org AS organization_id, 0.45 * ioc.s + 0.2 * CASE WHEN len(kw) = 0 THEN 0 ELSE len(list_intersect(t, kw)) / len(kw) END + 0.1 * CAST(list_contains(tlds, h.l[-1]) AS INT)
    + 0.15 * CASE WHEN {_ANY(names.SERVICE_WORDS)} AND {_ANY(names.LOGIN_WORDS)} AND {_ANY(names.SECURITY_WORDS)} THEN 0.9 WHEN {_ANY(names.SERVICE_WORDS)} AND {_ANY(names.LOGIN_WORDS)} AND {_ANY(names.UPDATE_WORDS)} THEN 0.85 WHEN {_ANY(names.LOGIN_WORDS)} AND {_ANY(names.SECURITY_WORDS)} THEN 0.6 ELSE 0 END
    + 0.1 * CAST(list_contains(['blog'], h.l[-2]) AS INT) AS score FROM h JOIN ioc ON h.host = ioc.host JOIN pr ON pr.org = ioc.org)
SELECT domain, CAST(rank AS INT) AS rank, organization_id, CAST(round(score, 6) AS DOUBLE) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round(CAST(score AS DOUBLE), 12) DESC, organization_id) AS rank FROM sc) WHERE rank <= 5
"""


def _profiles(spark, sf_dir) -> attribution.ProfileRows:
    known = _t(spark, sf_dir, "pages").where("url IS NOT NULL").select((F.col("page_id") % 20).alias("organization_id"), names.normal_domain(F.col("url")).alias("domain_name"))
    orgs = known.select(F.col("organization_id").alias("id")).distinct().select("id", F.concat(F.lit("Blog "), F.col("id").cast("string")).alias("name"))
    return attribution.profile_rows(orgs, known)


@query(rf"""
WITH o AS (SELECT DISTINCT page_id % 20 AS org, regexp_extract(lower(trim(url)), '^(?:[a-z]+://)?([^/?#:]*)', 1) AS ioc FROM pages WHERE url IS NOT NULL),
l AS (SELECT org, ioc, string_split(ioc, '.') AS l FROM o WHERE ioc <> ''),
k AS (SELECT org, {_PROFILES.format("flatten(list(regexp_split_to_array(array_to_string(l[:-2], '.'), '[-_.0-9]+')))")} AS kw, list_sort(list_distinct(list(l[-1]) FILTER (WHERE len(l) >= 2))) AS tlds, count(*) AS n FROM l GROUP BY org),
p AS (SELECT org, string_agg(ioc, ' ' ORDER BY ioc) AS iocs FROM l GROUP BY org)
SELECT k.org AS organization_id, 'Blog ' || CAST(k.org AS VARCHAR) AS name, CAST(n AS BIGINT) AS domains, iocs, array_to_string(kw, ' ') AS keywords, array_to_string(tlds, ' ') AS tlds FROM k JOIN p ON p.org = k.org
""")
def actor_profiles(spark, sf_dir):
    """The profiles as tables, put together to be shown."""
    p = _profiles(spark, sf_dir)
    listed = lambda df, c, by, name: df.groupBy("organization_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), F.col(c).alias("c"))))["c"], " ").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    out = p.organizations.select("organization_id", "name").join(listed(p.iocs, "ioc", "place", "iocs"), "organization_id")
    for df, c, name in ((p.keywords, "word", "keywords"), (p.tlds, "tld", "tlds")):
        out = out.join(listed(df, c, c, name).drop(f"n_{name}"), "organization_id", "left")
    return out.select("organization_id", "name", F.col("n_iocs").alias("domains"), "iocs", F.coalesce("keywords", F.lit("")).alias("keywords"), F.coalesce("tlds", F.lit("")).alias("tlds"))


def _found(spark, sf_dir, profiles: attribution.ProfileRows) -> DataFrame:
    return attribution.candidates(_hosts(spark, sf_dir).select(F.col("host").alias("domain")), profiles)


@query(_MATCH)
def actor_match_top5(spark, sf_dir):
    """Hosts against profiles built from all pages."""
    return _found(spark, sf_dir, _profiles(spark, sf_dir)).select("domain", "rank", "organization_id", F.round("score", 6).alias("score"), "confidence")


def _grouped(found: DataFrame) -> DataFrame:
    best = attribution.best_matches(found).where("organization_id IS NOT NULL").withColumn("organization_name", F.col("organization_id").cast("string"))
    return attribution.by_organization(best).select(F.col("organization").cast("long").alias("organization"), "n", F.array_join("domains", ",").alias("domains"))


_GROUPED = "SELECT organization_id AS organization, CAST(count(*) AS BIGINT) AS n, string_agg(domain, ',' ORDER BY domain) AS domains FROM ({0}) WHERE rank = 1 AND score > 0 GROUP BY 1"


@query(_GROUPED.replace("{0}", _MATCH))
def org_grouped_domains(spark, sf_dir):
    return _grouped(_found(spark, sf_dir, _profiles(spark, sf_dir)))


def _alert(spark, sf_dir, profiles: attribution.ProfileRows) -> DataFrame:
    hosts = _hosts(spark, sf_dir).select(F.col("host").alias("domain"), F.xxhash64("host").alias("position"))
    found = attribution.best_matches(attribution.candidates(hosts, profiles))
    alert = spark.createDataFrame([("a1", "s1")], "alert_id string, subscription_id string")
    document = attribution.alert_document(alert, attribution.alert_items(hosts, found))
    count = F.get_json_object("document", "$.summary.high_risk_count").cast("long")
    rows = housekeeping.alert_domains(alert, document)
    return rows.join(document.select("alert_id", count.alias("n_domains")), "alert_id").select("domain", F.round("risk_score", 6).alias("risk_score"), "risk_level", "n_domains")


_ALERT = rf"""
SELECT domain, CAST(round(score, 6) AS DOUBLE) AS risk_score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level, (SELECT CAST(count(*) AS BIGINT) FROM {_HOSTS}) AS n_domains FROM (__MATCH__) WHERE rank = 1
"""


@query(_ALERT.replace("__MATCH__", _MATCH))
def alert_document(spark, sf_dir):
    """The scalars of the alert document, read back from its JSON."""
    return _alert(spark, sf_dir, _profiles(spark, sf_dir))


@query(_ALERT.replace("__MATCH__", _MATCH))
def alert_file(spark, sf_dir):
    """The same from the file that is written by ranges."""
    hosts = _hosts(spark, sf_dir).select(F.col("host").alias("domain"), F.xxhash64("host").alias("position"))
    found = attribution.best_matches(_found(spark, sf_dir, _profiles(spark, sf_dir)))
    path = f"{scratch(spark, 'files')}/full_result.json"
    attribution.write_alert(spark.createDataFrame([("a1", "s1")], "alert_id string, subscription_id string"), attribution.alert_items(hosts, found), path)
    kind = "summary struct<high_risk_count: long>, high_risk_domains array<struct<domain: string, risk_score: double, risk_level: string>>"
    d = spark.read.schema(kind).json(path, multiLine=True).select("summary", F.explode("high_risk_domains").alias("x"))
    return d.select("x.domain", F.round("x.risk_score", 6).alias("risk_score"), "x.risk_level", F.col("summary.high_risk_count").alias("n_domains"))


_RULES = ("com", "org", "example.com", "*.org", "!example.org", "nowhere")


@query(rf"""
WITH h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM {_HOSTS}),
r AS (SELECT unnest({list(_RULES)!r}) AS rule),
e AS (SELECT host, n, array_to_string(l[-n:], '.') AS e, '*' || substr(array_to_string(l[-n:], '.'), length(l[-n]) + 1) AS wild FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS n FROM h)),
k AS (SELECT host, max(CASE WHEN '!' || e IN (SELECT rule FROM r) THEN n - 1 END) AS x, max(CASE WHEN e IN (SELECT rule FROM r) OR wild IN (SELECT rule FROM r) THEN n END) AS m FROM e GROUP BY host),
c AS (SELECT h.host, l, coalesce(x, m, 0) AS n FROM h LEFT JOIN k ON h.host = k.host)
SELECT host AS domain, CASE WHEN len(l) > n THEN l[len(l) - n] ELSE '' END AS sld, CASE WHEN n = 0 THEN '' ELSE array_to_string(l[-n:], '.') END AS tld FROM c
""")
def public_suffix_parts(spark, sf_dir):
    """Hosts divided by a table of public suffixes, with rules for any label and an exception."""
    rules = spark.createDataFrame([(r,) for r in _RULES], "rule string")
    return attribution.public_suffixes(rules)(_hosts(spark, sf_dir).select(F.col("host").alias("domain")))


@query(rf"""
SELECT host AS domain, l[-2] AS sld, l[-1] AS tld, array_to_string(list_filter(regexp_split_to_array(host, '[-_.0-9]+'), lambda x: x <> ''), ' ') AS tokens,
  (SELECT CAST(count(DISTINCT page_id % 20) AS BIGINT) FROM pages WHERE url IS NOT NULL) AS candidate_count FROM (SELECT host, string_split(host, '.') AS l FROM {_HOSTS})
""")
def match_snapshots(spark, sf_dir):
    """What is kept beside a match of what its score saw, read back from its JSON."""
    hosts = _hosts(spark, sf_dir).select(F.col("host").alias("domain"))
    kind = "domain_features struct<domain: string, sld: string, tld: string, tokens: array<string>>, candidate_count long"
    rows = attribution.with_snapshot(hosts, _profiles(spark, sf_dir)).select("domain", F.from_json("enrichment_snapshot", kind).alias("s"))
    return rows.select("domain", "s.domain_features.sld", "s.domain_features.tld", F.array_join("s.domain_features.tokens", " ").alias("tokens"), "s.candidate_count")


@query(rf"""
WITH h AS (SELECT host FROM {_HOSTS}), n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM h), k AS (SELECT CAST(count(*) AS BIGINT) AS k FROM h WHERE host LIKE 'blog.%')
SELECT host AS name, host NOT LIKE 'blog.%' AS fresh, n AS ids, n.n - k.k + 1000 AS last FROM h, n, k
""")
def domains_created(spark, sf_dir):
    """Names that are no domains yet get the ids after the largest, without gaps."""
    h = _hosts(spark, sf_dir)
    there = h.where("startswith(host, 'blog.')").select(F.upper("host").alias("domain_name"), F.lit(1000).alias("id"))
    there = numbered(there.drop("id"), "domain_name", "n").select((1001 - F.col("n")).cast("int").alias("id"), "domain_name")
    all_names = h.select(F.col("host").alias("domain")).unionByName(h.select(F.initcap("host").alias("domain")))
    rows = attribution.create_domains(there, all_names, F.lit(AS_OF))
    sums = rows.agg(F.count_distinct("id").alias("ids"), F.max("id").cast("long").alias("last"))
    return rows.select(F.lower("domain_name").alias("name"), (F.col("id") > 1000).alias("fresh")).join(F.broadcast(sums))


# Look-alikes -----------------------------------------------------------------------------------------------

_NAMED = "SELECT DISTINCT regexp_extract(lower(trim(url)), '^(?:[a-z]+://)?([^/?#:]*)', 1) AS t FROM pages WHERE url IS NOT NULL"


@query(rf"""
SELECT d AS domain FROM ({_NAMED.replace("AS t", "AS d")}) WHERE EXISTS (SELECT 1 FROM ({_NAMED}) WHERE t <> d AND levenshtein(replace(d, '.', ''), replace(t, '.', '')) <= greatest(2, least(6, length(replace(t, '.', '')) // 2)))
""")
def edit_distance_candidates(spark, sf_dir):
    """Every host against all other hosts."""
    h = _hosts(spark, sf_dir)
    return lookalike.within_reach(h.select(F.col("host").alias("domain")), h.select(F.col("host").alias("target")), itself=False)


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS r FROM e),
s AS (SELECT q.vec_id AS vec_id, t.vec_id AS target, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * t.e[i])) / (q.r * t.r) AS c FROM n q JOIN n t ON q.vec_id <> t.vec_id)
SELECT vec_id, target, round(c, 6) AS similarity, c > 0.35 AS matched FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 12) DESC, target) AS k FROM s) WHERE k = 1
""")
def lookalike_match(spark, sf_dir):
    """Every vector against all others."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumn("ord", F.col("vec_id"))
    best = lookalike.best_target(e, e, {"embedding": 1.0}, "vec_id", "vec_id", "ord", itself=False)
    return best.select("vec_id", "target", F.round("similarity", 6).alias("similarity"), (F.col("similarity") > 0.35).alias("matched"))


_COSINE = "CASE WHEN list_sum(list_transform(a.{0}, lambda x: x * x)) * list_sum(list_transform(b.{0}, lambda x: x * x)) = 0 THEN 0 ELSE list_sum(list_transform(range(1, 65), lambda i: a.{0}[i] * b.{0}[i])) / sqrt(list_sum(list_transform(a.{0}, lambda x: x * x))) / sqrt(list_sum(list_transform(b.{0}, lambda x: x * x))) END"
_SLOTS = "list_transform({0}, lambda g: CAST('0x' || substr(md5(g), 1, 4) AS INT) % 64)"
_COUNTS = "list_transform(range(64), lambda k: CAST(len(list_filter({0}, lambda s: s = k)) AS DOUBLE))"


@query(rf"""
WITH h AS (SELECT DISTINCT host, replace(host, '.', '') AS k FROM {_HOSTS} WHERE host <> ''),
slots AS (SELECT host, k, {_SLOTS.format(_GRAMS.format("host"))} AS f, {_SLOTS.format(_GRAMS.format("k"))} AS g FROM h),
v AS MATERIALIZED (SELECT host, k, {_COUNTS.format("f")} AS f, {_COUNTS.format("g")} AS g FROM slots),
near AS (SELECT * FROM v WHERE EXISTS (SELECT 1 FROM h WHERE h.host <> v.host AND levenshtein(v.k, h.k) <= greatest(2, least(6, length(h.k) // 2)))),
s AS (SELECT a.host AS domain, b.host AS target, length(b.k) AS n, 0.7 * ({_COSINE.format("g")}) + 0.3 * ({_COSINE.format("f")}) AS s FROM near a JOIN v b ON a.host <> b.host),
m AS (SELECT domain, target, 'Owner of ' || target AS company, printf('%.4f', CAST(s AS DOUBLE)) AS similarity, 'semantic' AS match_type
  FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round(CAST(s AS DOUBLE), 12) DESC, target) AS r FROM s) WHERE r = 1 AND s > CASE WHEN n <= 4 THEN 0.92 WHEN n <= 6 THEN 0.88 ELSE 0.85 END),
t AS (SELECT CAST((SELECT count(*) FROM h) AS BIGINT) AS total, CAST((SELECT count(*) FROM m) AS BIGINT) AS phishing)
SELECT total, phishing, total - phishing AS benign, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * phishing / total END AS phishing_rate, m.* FROM t LEFT JOIN m ON TRUE
""".replace("'semantic'", f"'{labels.MATCH_TYPE}'"))
def lookalike_hosts(spark, sf_dir):
    """The whole operator: every host against all other hosts, with the statistics beside each match."""
    hosts = _hosts(spark, sf_dir).where("host <> ''").select(F.col("host").alias("domain"))
    official = in_order(hosts, ["domain"], "position").select(F.concat(F.lit("Owner of "), "domain").alias("company"), "domain", "position")
    matches, stats = lookalike.look_alikes(hosts, official, itself=False)
    return stats.join(matches, how="left")


# Detection -------------------------------------------------------------------------------------------------


@query("""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS malicious, CAST(sum(CASE WHEN toxic = 1 THEN 0 ELSE 1 END) AS BIGINT) AS benign,
  100.0::DOUBLE * sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) / count(*) AS rate, printf('%.2f%%', 100.0::DOUBLE * sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) / count(*)) AS rate_text FROM labels
""")
def detection_stats(spark, sf_dir):
    return detection.statistics(_t(spark, sf_dir, "labels"), F.col("toxic") == 1)


@query("""
SELECT domain, event_id FROM (SELECT lower(event_type) || CAST(user_id % 50 AS VARCHAR) AS domain, event_id, row_number() OVER (PARTITION BY lower(event_type) || CAST(user_id % 50 AS VARCHAR) ORDER BY event_id) AS k
  FROM events WHERE value / 600 > 0.05 AND event_type <> 'view') WHERE k = 1
""")
def alert_filter_dedup(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.concat("event_type", (F.col("user_id") % 50).cast("string")).alias("domain"), F.when(F.col("event_type") != "view", 1).otherwise(0).alias("predicted"), (F.col("value") / 600).alias("probability"))
    return detection.alert_rows(e, 5.0, position="event_id").select("domain", "event_id")


@query("""
WITH c AS (SELECT CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS DOUBLE) AS tn FROM labels)
SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c
""")
def classifier_metrics(spark, sf_dir):
    return detection.metrics(_t(spark, sf_dir, "labels").withColumn("p", 1 - F.col("toxic")), "quality", "p")


@query("SELECT o_orderstatus AS status, printf('%.2f%%', 100.0::DOUBLE * count(*) FILTER (WHERE o_totalprice > 200000) / count(*)) AS share FROM orders GROUP BY 1")
def ratio_text(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.when(F.col("o_totalprice") > 200000, 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    return o.select("status", percent_text(F.col("k"), F.col("n")).alias("share"))


def _labelled(spark, sf_dir) -> DataFrame:
    """Hosts of pages with the label of the document of the same number, which no feature holds; one row for each page."""
    p = _t(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", names.normal_domain(F.col("url")).alias("domain"))
    label = _t(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("toxic").alias("label"))
    return stored(detection.with_features(p.join(label, "page_id")), "labelled")


@query()
def train_and_score(spark, sf_dir):
    """A forest on lexical features of hosts; accuracy and the like on held-out rows."""
    fit, held = detection.stratified_split(_labelled(spark, sf_dir), "label", "page_id")
    model = detection.train(fit)
    return detection.metrics(detection.predict(model, held), "label", "predicted")


@query()
def forest_scores(spark, sf_dir):
    """Every host by a forest fitted on labelled ones, stored as a table of nodes and read again; from a probability of 0.3 on a host counts as malicious."""
    nodes = stored(forest.node_table(detection.train(_labelled(spark, sf_dir))), "nodes")
    return forest.score(nodes, detection.with_features(_hosts(spark, sf_dir), "host"), 0.3).select("host", "predicted", "label_text", "probability")


#: A stored model of two trees. tree, node, feature (from 0), shift, scale, threshold, left, right, shares of both classes, depth.
_MODEL = (
    (0, 0, 2, 4.0, 0.5, 0.25, 1, 2, 0.6, 0.4, 2),
    (0, 1, None, None, None, None, None, None, 0.9, 0.1, 2),
    (0, 2, 9, 3.0, 1.0, 0.0, 3, 4, 0.3, 0.7, 2),
    (0, 3, None, None, None, None, None, None, 0.625, 0.375, 2),
    (0, 4, None, None, None, None, None, None, 0.125, 0.875, 2),
    (1, 0, 21, 3.0, 2.0, 0.4567, 1, 2, 0.5, 0.5, 3),
    (1, 1, 0, 0.0, 1.0, 6.5, 3, 4, 0.7, 0.3, 3),
    (1, 2, None, None, None, None, None, None, 0.25, 0.75, 3),
    (1, 3, None, None, None, None, None, None, 0.8, 0.2, 3),
    (1, 4, 10, 5.0, 1.0, -0.5, 5, 6, 0.4, 0.6, 3),
    (1, 5, None, None, None, None, None, None, 0.5, 0.5, 3),
    (1, 6, None, None, None, None, None, None, 0.375, 0.625, 3),
)
_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"{x}" for x in r) + ")" for r in _MODEL)


@query(rf"""
WITH RECURSIVE n(tree, node, feature, shift, scale, threshold, l, r, share_0, share_1, depth) AS (VALUES {_ROWS}),
v AS (SELECT host, [sld_length, rest_length, parts, part_mean, entropy] AS f FROM ({_LEX})),
w AS (
  SELECT host, f, tree, 0 AS node FROM v, (SELECT DISTINCT tree FROM n)
  UNION ALL
  SELECT host, f, w.tree, CASE WHEN (f[CASE feature WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 9 THEN 3 WHEN 10 THEN 4 ELSE 5 END] - shift) * scale <= threshold THEN l ELSE r END FROM w JOIN n ON n.tree = w.tree AND n.node = w.node WHERE feature IS NOT NULL),
s AS (SELECT host, sum(CAST(share_0 AS DOUBLE)) AS a, sum(CAST(share_1 AS DOUBLE)) AS b FROM w JOIN n ON n.tree = w.tree AND n.node = w.node WHERE feature IS NULL GROUP BY host)
SELECT host, CASE WHEN b / (a + b) >= 0.5 THEN 1 ELSE 0 END AS predicted, CASE WHEN b / (a + b) >= 0.5 THEN '{detection.MALICIOUS}' ELSE '{detection.BENIGN}' END AS label_text, round(b / (a + b), 9) AS probability FROM s
""")
def stored_forest(spark, sf_dir):
    """Every host by a forest that is given as a table of nodes."""
    nodes = spark.createDataFrame(_MODEL, forest.NODES)
    return forest.score(nodes, detection.with_features(_hosts(spark, sf_dir), "host"), 0.5).select("host", "predicted", "label_text", F.round("probability", 9).alias("probability"))


@query("""
WITH c AS (SELECT quality, toxic, toxic * 2 + quality AS label FROM labels), n AS (SELECT label, count(*) AS n FROM c GROUP BY label),
f AS (SELECT label, n, sum(n) OVER () - ceil(round(sum(n) OVER () * 0.2::DOUBLE, 6)) AS fit, sum(n) OVER () AS total FROM n),
q AS (SELECT label, n, fit, floor(n * fit / total) AS take, n * fit / total - floor(n * fit / total) AS rest FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY round(rest, 9) DESC, label) AS k, fit - sum(take) OVER () AS more FROM q)
SELECT CAST(label AS INT) AS label, CAST(take + CASE WHEN k <= more THEN 1 ELSE 0 END AS BIGINT) AS fit, CAST(n - take - CASE WHEN k <= more THEN 1 ELSE 0 END AS BIGINT) AS held FROM r
""")
def split_shares(spark, sf_dir):
    """How many rows of each of four labels are for training, and for the test."""
    rows = _t(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") * 2 + F.col("quality")).cast("int").alias("label"))
    fit, held = detection.stratified_split(rows, "label", "doc_id")
    both = fit.withColumn("fit", F.lit(1)).unionByName(held.withColumn("fit", F.lit(0)))
    return both.groupBy("label").agg(F.count(F.when(F.col("fit") == 1, 1)).alias("fit"), F.count(F.when(F.col("fit") == 0, 1)).alias("held"))


@query()
def segmented_features(spark, sf_dir):
    """The features that depend on words, by a small dictionary of words."""
    h = _hosts(spark, sf_dir)
    segment = lexical.dictionary_segmenter({"ads": 9.0, "track": 8.0, "example": 40.0, "blog": 30.0, "the": 90.0, "ran": 4.0, "ren": 1.0, "her": 12.0, "tion": 1.0})
    return detection.with_features(h, "host", segment).select("host", *[f"edit_{k}" for k in lexical.EDIT_WORDS], "words", "split_parts", "split_mean")
