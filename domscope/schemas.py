"""Schemas of the engine's tables. JSON columns are typed; open-ended ones stay strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DDL = {
    "users": "id long, username string, email string, bio string, created_at timestamp_ntz",
    "models": "id long, name string, version string, description string, model_type string, model_category string, is_public boolean, created_by string, status string, created_at timestamp_ntz",
    "files": "id long, bucket string, object_key string, filename string, size long, metadata string, created_at timestamp_ntz",
    "tasks": "id long, task_id string, task_type string, model_id long, file_id long, extra string, status string, created_by string, created_at timestamp_ntz",
    "training_tasks": "id long, task_id string, user_id long, training_status string, progress double, accuracy_metrics string, started_at timestamp_ntz, created_at timestamp_ntz",
    "user_models": "id long, user_id long, model_id long, source string, acquired_at timestamp_ntz, is_active boolean",
    "subscriptions": "id long, subscription_id string, user_id long, model_id long, frequency string, threshold decimal(5,2), next_run_at timestamp_ntz, is_active boolean, official_file_id long",
    "alerts": "id long, alert_id string, subscription_id string, task_id string, user_id long, detected_count int, high_risk_count int, threshold decimal(5,2), status string, notified boolean, created_at timestamp_ntz",
    "alert_files": "id long, alert_id string, file_id long, file_role string, file_format string, domain_count int, alert_date date, created_at timestamp_ntz",
    "alert_details": "id long, alert_id string, high_risk_domains string",
    "alert_domain_matches": "id long, alert_id string, domain_id long, domain_name string, organization_id int, organization_name string, actor_score decimal(6,4), confidence string, evidence string, top_candidates string, status string, created_at timestamp_ntz",
    "apt_organizations": "id int, name string, alias array<string>, description string, ioc_count int, event_count int, update_time date, region string, origin string, target_countries array<string>, target_industries array<string>, previous_domains array<string>, vps_providers array<struct<provider:string,count:int,percentage:double>>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "apt_events": "id int, event_date date, title string, description string, event_type string, region string, latitude decimal(10,7), longitude decimal(10,7), organization_id int, severity int, report_url string, created_at timestamp_ntz",
    "region_event_stats": "stat_date date, region string, event_count int, major_count int",
    "domains": "id int, domain_name string, is_malicious boolean, first_seen date, last_seen date, organization_id int, created_at timestamp_ntz",
    "whois_info": "id int, domain_id int, registrar string, registration_date date, expiration_date date, updated_date date, name_servers array<string>, registrant struct<name:string,organization:string,country:string,email:string,address:string>, admin string, tech string, status array<string>, raw_text string, query_time timestamp_ntz",
    "dns_records": "id int, domain_id int, record_type string, record_name string, record_value string, ttl int, priority int",
    "ssl_certificates": "id int, domain_id int, issuer map<string,string>, subject map<string,string>, serial_number string, fingerprint string, not_before timestamp_ntz, not_after timestamp_ntz, algorithm string, key_size int, san_names array<string>, is_expired boolean, is_self_signed boolean, created_at timestamp_ntz",
    "threat_statistics": "stat_date date, total_organizations long, total_events long, total_domains long, total_iocs long, active_threats long, new_threats_today long",
    "threat_trends": "trend_date date, dns_tunnel_count long, dga_domain_count long, phishing_count long, c2_communication_count long, malware_count long",
    "attack_sources": "country string, attack_count long, last_attack_date date",
}
STAGING = {
    "organizations": "id name aliases origin region target_countries target_industries update_time description ioc_count event_count".split(),
    "events": "id event_date title description threat_type organization_id releasing_product link".split(),
    "domains": "id domain_name is_malicious first_seen last_seen organization_id".split(),
}


def schema(table: str) -> StructType:
    """The schema of a table. Parsing it takes a session."""
    return StructType.fromDDL(DDL[table])


# Fixed values of enumerated columns.
ENUMS = {
    ("tasks", "status"): ("pending", "processing", "completed", "failed"),
    ("tasks", "task_type"): ("malicious", "impersonation"),
    ("subscriptions", "frequency"): ("daily", "weekly", "monthly"),
    ("alert_domain_matches", "status"): ("pending", "confirmed", "rejected", "ignored", "reviewing"),
    ("apt_events", "event_type"): ("major", "normal"),
}


def outside_enum(df: DataFrame, table: str) -> DataFrame:
    """The rows of ``df`` that hold a value its enumerated columns don't allow; nulls are allowed."""
    tests: list[Column] = [F.col(c).isNotNull() & ~F.col(c).isin(*values) for (t, c), values in ENUMS.items() if t == table and c in df.columns]
    wrong = F.lit(False)
    for t in tests:
        wrong = wrong | t
    return df.where(wrong)


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the table's columns in order; columns it lacks are null, others are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])
