"""Live attributes of domains - WHOIS, DNS, certificates - by a resolver that the caller brings.

The engine itself opens no connection. A resolver is a function from a domain to a dictionary with the keys
whois (dictionary), dns (list of type, value, ttl) and certificate (dictionary), each optional.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD_TYPES = ("A", "AAAA", "MX", "NS", "TXT", "CNAME", "SOA")
_FIELDS = {
    "domain": "string", "registrar": "string", "registration_date": "string", "expiration_date": "string", "name_servers": "array<string>", "status": "array<string>",
    "dns": "array<struct<record_type: string, record_value: string, ttl: long, priority: long>>", "issuer": "map<string,string>", "subject": "map<string,string>", "not_before": "string", "not_after": "string",
    "san_names": "array<string>", "error": "string",
}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in _FIELDS.items())
_RECORD = pa.struct([("record_type", pa.string()), ("record_value", pa.string()), ("ttl", pa.int64()), ("priority", pa.int64())])
_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(_RECORD), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]


def first_of(value):
    """The first item of a list, else the value; None for an empty list."""
    return (value[0] if value else None) if isinstance(value, (list, tuple)) else value


def listed(value) -> list[str]:
    """A list of texts from a list or a single value."""
    return [] if value is None else [str(v) for v in value] if isinstance(value, (list, tuple, set)) else [str(value)]


def record(kind: str, value: str, ttl: int | None) -> dict | None:
    """A DNS record of a known type: a final dot goes, an MX's priority is told apart."""
    if kind not in RECORD_TYPES:
        return None
    priority = None
    if kind == "MX" and " " in value.strip():
        head, _, value = value.strip().partition(" ")
        priority = int(head) if head.isdigit() else None
    return {"record_type": kind, "record_value": value.strip().rstrip("."), "ttl": ttl, "priority": priority}


def _row(domain: str, resolve: Callable[[str], dict]) -> tuple:
    try:
        got = resolve(domain) or {}
    except Exception as e:  # a name that can't be looked up is a result too
        return (domain, None, None, None, [], [], [], None, None, None, None, [], f"{type(e).__name__}: {e}")
    w, c = got.get("whois") or {}, got.get("certificate") or {}
    dns = [r for r in (record(k, v, t) for k, v, t in got.get("dns") or []) if r]
    text = lambda v: None if v is None else str(v)
    pairs = lambda v: None if v is None else [(str(a), text(b)) for a, b in dict(v).items()]
    san = [v for k, v in c.get("subject_alt_names") or [] if k == "DNS"]
    return (domain, text(first_of(w.get("registrar"))), text(first_of(w.get("creation_date"))), text(first_of(w.get("expiration_date"))), listed(w.get("name_servers")), listed(w.get("status")), dns, pairs(c.get("issuer")), pairs(c.get("subject")), text(c.get("not_before")), text(c.get("not_after")), san, None)


def look_up(domains: DataFrame, resolve: Callable[[str], dict], domain: str = "domain", parallel: int | None = None) -> DataFrame:
    """The attributes of each distinct domain. ``parallel`` bounds how many lookups run at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(d, resolve) for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES], list(_FIELDS))

    names = domains.select(F.col(domain).alias("domain")).where("domain IS NOT NULL").distinct()
    return (names.repartition(parallel) if parallel else names).mapInArrow(run, SCHEMA)
