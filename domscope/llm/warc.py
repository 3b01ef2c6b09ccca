"""WARC archives of page captures, and one globally ordered index of them.

Writing: each task appends gzip members, a record each, to files of a bounded size in a shared folder,
and reports the files it ended. A file has a name of its own for each attempt of a task, so those of lost
attempts are never listed. Of captures with equal payloads, at least ``least_bytes`` long, the one with
the largest id is a response; the others are revisits that refer to it. Equal means the same SHA-1 and length.

Reading: each archive is read in a stream, once, member by member. A task's index entries, up to RUN_ENTRIES at a time, are
sorted by URL key, time and id and stored as a run, a Parquet file with many small row groups. Ranges of this order - so a
URL with very many captures is spread over several - are cut at quantiles of the row groups' first entries. For each
range one task is told which row groups of which files reach into it (Spark finds that by each file's own list of first entries),
opens these and merges the streams with a loser tree, so it
holds a few hundred entries of each run, however long the range is. Ranges in order are the global index. More than FAN
runs are first merged in groups, also range by range, into fewer and longer ones.

Null payloads count as empty, null URLs as the empty URL, null ids come before all others. Every row gets a record. Rows
that share id, URL, time and payload are told apart by number; of captures that share the largest id the greatest URL, then
time, is the response. Very long payloads are records of their own like others; a table without rows gives an empty index.
Other columns are left out, so no name clashes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, lean, scratch_path, written

#: An archive is ended when it has so many bytes.
FILE_BYTES = 16 << 20
#: A run has so many entries at most, which one task sorts in memory.
RUN_ENTRIES = 100_000
#: A range of the index has about so many; one task merges it in a stream.
RANGE_ENTRIES = 500_000
#: So many runs are merged at a time.
FAN = 128
ROW_GROUP, BATCH = 2048, 256
ENTRY = "url_key string, ts long, id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def digest32(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """The sort key of a URL: host labels from the right, then port, path and query, lower-cased; scheme,
    user and fragment don't count, nor does a leading www."""
    try:
        s = urlsplit(url.strip())
        host, port = (s.hostname or "").removeprefix("www."), s.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    port_text = f":{port}" if port and (s.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = "?" + "&".join(sorted(s.query.split("&"))) if s.query else ""
    return (",".join(reversed(host.split("."))) + port_text + ")" + (s.path.rstrip("/") or "/") + query).lower()


def _date(ts: int) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(ts, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _seconds(date: str) -> int:
    from datetime import datetime, timezone

    return int(datetime.strptime(date, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())


def record_name(capture: int | None, url: str, ts: int, digest: str, number: int) -> str:
    """The name of a record, which no other one has: ``number`` tells apart captures that are alike in all else."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{capture} {ts} {digest} {number} {url}')}>"


def record(capture: int | None, url: str, ts: int, digest: str, size: int, payload: bytes, number: int = 0, original: tuple | None = None) -> bytes:
    """A WARC/1.1 record. ``digest`` is the bare base32 SHA-1 of the payload. A revisit holds no payload but names the
    capture it repeats, ``original``: its id, URL and time."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {record_name(capture, url, ts, digest, number)}",
        *[f"WARC-Capture: {capture}"] * (capture is not None),
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {_date(ts)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if original is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(*original, digest, 0)}"]
        head += [f"WARC-Refers-To-Capture: {original[0]}"] * (original[0] is not None)
    body = b"" if original is not None else payload
    head += ["Content-Type: text/html;charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the body."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4:
        raise ValueError("a WARC record of another length than it says")
    return fields, rest[:n]


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


_CAPTURE = ["name", "url", "ts", "digest", "n"]


def originals(captures: DataFrame, least_bytes: int) -> DataFrame:
    """Of distinct captures and their ``copies``: those whose payload has others, with the original, a struct of id, url, ts, name.
    Narrow rows only are shuffled; equal payloads are counted before that."""
    head = F.max(F.struct("id", "url", "ts", "name")).alias("original")
    groups = captures.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(head, F.sum("copies").alias("all")).where("all > 1").drop("all")
    groups = written(groups, "originals")  # as an input of its own, so that the join below can split a payload with very many copies
    return captures.join(groups, ["digest", "n"]).select(*_CAPTURE, "original")


def write_archives(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts: str | None = None) -> DataFrame:
    """Archives of all captures; returns one row (archive, records) per file, already written.

    ``ts`` is an SQL expression for a capture's second; by default one per id from 2024-01-01 on. The payloads
    are shuffled once, by all that tells captures apart; captures that are alike in all of it are put together before.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    when = F.expr(ts) if ts else F.lit(1704067200) + F.pmod(F.col(id_col), F.lit(31536000))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"),
        F.coalesce(when.cast("long"), F.lit(1704067200)).alias("ts"),
    ).withColumns({"digest": F.sha1(F.col("payload")), "n": F.octet_length("payload")})
    count = F.count(F.lit(1)).alias("copies")
    captures = written(rows.groupBy("id", *_CAPTURE).agg(count), "captures")
    full = rows.groupBy(*_CAPTURE).agg(F.first("id").alias("id"), F.first("payload").alias("payload"), count).join(originals(captures, least_bytes), _CAPTURE, "left")
    full = full.select("id", "name", "url", "ts", "digest", "n", "payload", "copies", "original")

    def write(batches: Batches) -> Batches:
        fs, base = open_fs(folder)
        out, size, n, name = None, 0, 0, ""
        for batch in batches:
            for at in range(batch.num_rows):  # payloads one at a time
                i, own, u, t, hexed, length, payload, copies, first = (c[at].as_py() for c in batch.columns)
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                for k in range(copies):
                    # Below the least length all are responses; else the first copy of the original capture is.
                    alone = first is None or (k == 0 and (first["name"], first["url"], first["ts"]) == (own, u, t))
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, size, n = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = z.compress(record(i, u, t, digest, length, payload, k, None if alone else (first["id"], first["url"], first["ts"]))) + z.flush()
                    out.write(member)
                    size, n = size + len(member), n + 1
                    if size >= FILE_BYTES:
                        out.close()
                        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], ["archive", "records"])
                        out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], ["archive", "records"])

    return written(full.mapInArrow(lean(write), "archive string, records long"), "warc-list")


def read_members(fs: pafs.FileSystem, path: str) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member, in a stream."""
    with fs.open_input_stream(path, compression=None) as f:
        offset, data = 0, b""
        while True:
            z = zlib.decompressobj(31)
            parts, used = [], 0
            while not z.eof:
                if not data:
                    data = f.read(1 << 20)
                    if not data:
                        if parts or used:
                            raise ValueError(f"{path} ends within a member")
                        return
                parts.append(z.decompress(data))
                used += len(data) - len(z.unused_data)
                data = z.unused_data
            yield offset, used, b"".join(parts)
            offset += used


_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in (x.split() for x in ENTRY.split(", "))])
_KEY = itemgetter(0, 1, 2, 8, 9)
_KEYS = ["url_key", "ts", "id", "archive", "offset"]
_MARK = "struct<url_key: string, ts: bigint, id: bigint, archive: string, offset: bigint>"
#: A run is one file, or several that follow one another: run, place, file, entries, and the first entry of each row group.
_RUN = f"run long, place int, file string, entries long, marks array<{_MARK}>"
_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")[:4]] + ["marks"]
_MARKS = pa.list_(pa.struct([(k, pa.string() if k in ("url_key", "archive") else pa.int64()) for k in _KEYS]))
_LEAST = -(2**63)


def _order(entry: tuple) -> tuple:
    """The place of an entry: URL key, time, id - none before all others; then archive and offset, for captures that are alike."""
    url, ts, i, archive, offset = _KEY(entry)
    return url, ts, _LEAST if i is None else i, archive, offset


def _store(folder: str, entries: Iterator[tuple]) -> tuple[str, int, list[dict]] | None:
    """Sorted entries as a file: its name, their number, and the first of each row group and the last of all; None without any."""
    fs, base = open_fs(folder)
    name, n, marks, held = f"{uuid.uuid4().hex}.run", 0, [], []
    with fs.open_output_stream(f"{base}/{name}", compression=None) as out, pq.ParquetWriter(out, _SCHEMA, compression="zstd") as writer:

        def flush() -> None:
            marks.append(dict(zip(_KEYS, _order(held[0]))))
            writer.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA), row_group_size=ROW_GROUP)
            held.clear()

        for e in entries:
            held.append(e)
            n += 1
            if len(held) == ROW_GROUP:
                flush()
        if held:
            flush()
    if not n:
        return None
    marks.append(dict(zip(_KEYS, _order(e))))
    return f"{folder}/{name}", n, marks


def _load(files: list[tuple[str, int, int]], low: tuple | None, high: tuple | None) -> Iterator[tuple[tuple, tuple]]:
    """(order, entry) of a run's entries from ``low`` on and below ``high``, in a stream. ``files``: a file, the first and the last of its row groups
    that reach into the range."""
    for file, first, last in files:
        fs, path = open_fs(file)
        with fs.open_input_file(path) as source, pq.ParquetFile(source, pre_buffer=False) as stored:
            for batch in stored.iter_batches(BATCH, row_groups=list(range(first, last + 1))):
                for e in zip(*(c.to_pylist() for c in batch.columns)):
                    order = _order(e)
                    if high is not None and order >= high:
                        return
                    if low is None or order >= low:
                        yield order, e


def read_runs(archives: DataFrame) -> DataFrame:
    """Sorted runs of index entries, checked against the payloads' digests: a row for each run's file, already written."""
    folder = scratch_path(archives.sparkSession, "warc-runs")

    def entries(archive: str) -> Iterator[tuple]:
        fs, path = open_fs(archive)
        for offset, length, data in read_members(fs, path):
            h, body = parse_record(data)
            digest = h["warc-payload-digest"].removeprefix("sha1:")
            if h["warc-type"] == "response" and digest32(body) != digest:
                raise ValueError(f"{archive}: a payload with another digest at {offset}")
            number = lambda field: int(h[field]) if field in h else None
            url = h["warc-target-uri"]
            yield url_key(url), _seconds(h["warc-date"]), number("warc-capture"), url, int(h["warc-payload-length"]), digest, h["warc-type"], number("warc-refers-to-capture"), archive, offset, length

    def read(batches: Batches) -> Batches:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 33, []

        def run() -> pa.RecordBatch:
            nonlocal number
            held.sort(key=_order)
            file, n, marks = _store(folder, iter(held))
            held.clear()
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([0], pa.int32()), pa.array([file]), pa.array([n]), pa.array([marks], _MARKS)], _RUN_NAMES)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                for e in entries(archive):
                    held.append(e)
                    if len(held) == RUN_ENTRIES:
                        yield run()
        if held:
            yield run()

    n = max(archives.sparkSession.sparkContext.defaultParallelism, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(archives.select("archive").repartition(n).mapInArrow(lean(read), _RUN), "warc-run-list")


class LoserTree:
    """Merges runs of (key, entry) pairs in order of their keys: the inner nodes hold the losers of the matches below them, so the next entry
    takes one match on each level of the path from its run's leaf."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = len(runs)
        self.head = [next(r, None) for r in self.runs]
        self.loser = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """Whether a's head comes before b's. Ended runs come last; ties go to the first run."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.loser[node] < 0:  # the first to come here waits for its match
                self.loser[node] = winner
                return
            if self._beats(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.head[self.loser[0]] is not None:
            first = self.loser[0]
            yield self.head[first]
            self.head[first] = next(self.runs[first], None)
            self._play(first)


def _ranges(runs: DataFrame, n: int) -> list[tuple]:
    """At most n - 1 entries, rising, that cut the order of all entries into ranges of about the same size."""
    marks = runs.select(F.inline("marks")).repartitionByRange(n, *_KEYS).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*_KEYS)).alias("m"))
    return sorted(tuple(r.m) for r in marks.collect())[1:]  # n rows at most


_SLICE = "run long, place int, file string, first int, last int"


def _slices(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """range, run, place, file, first, last: for each range the files that reach into it and which of their row groups do. There is a row for
    each row group at most, and one more for each range that a row group crosses into; marks stay where they are."""
    shared = runs.sparkSession.sparkContext.broadcast(cuts)  # an entry for each RANGE_ENTRIES captures

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for number, place, file, marks in zip(*(batch.column(c).to_pylist() for c in ("run", "place", "file", "marks"))):
                at = [bisect_right(shared.value, tuple(m[k] for k in _KEYS)) for m in marks]
                reach: dict[int, list[int]] = {}
                for g in range(len(marks) - 1):
                    for r in range(at[g], at[g + 1] + 1):
                        reach.setdefault(r, [g, g])[1] = g
                for r, (first, last) in reach.items():
                    for column, value in zip(out, (r, number, place, file, first, last)):
                        column.append(value)
            types = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["range", *(x.split()[0] for x in _SLICE.split(", "))])

    return runs.select("run", "place", "file", "marks").mapInArrow(lean(run), f"range int, {_SLICE}")


def _listed() -> Column:
    """The slices of a task, by run and place."""
    return F.array_sort(F.collect_list(F.struct("run", "place", "file", "first", "last"))).alias("slices")


def _merged(slices: list[dict], place: int, cuts: list[tuple]) -> Iterator[tuple]:
    """The entries of a range, from the slices of all its runs."""
    runs: dict[int, list] = {}
    for x in slices:
        runs.setdefault(x["run"], []).append((x["file"], x["first"], x["last"]))
    low, high = (cuts[place - 1] if place else None), (cuts[place] if place < len(cuts) else None)
    return (e for _, e in LoserTree([_load(files, low, high) for files in runs.values()]))


def _fewer(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Each FAN runs merged into one, a task for each of these and each range."""
    spark, folder = runs.sparkSession, scratch_path(runs.sparkSession, "warc-runs")
    groups = -(-runs.select("run").distinct().count() // FAN)
    shared = spark.sparkContext.broadcast(cuts)
    dealt = _slices(runs, cuts).withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(groups)))
    tasks = dealt.groupBy("grp", "range").agg(_listed())  # slices of about FAN runs

    def merge(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(batch.num_rows):
                grp, place, slices = (batch.column(c)[at].as_py() for c in ("grp", "range", "slices"))
                stored = _store(folder, _merged(slices, place, shared.value))
                if stored:
                    file, n, marks = stored
                    yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([place], pa.int32()), pa.array([file]), pa.array([n]), pa.array([marks], _MARKS)], _RUN_NAMES)

    return written(tasks.mapInArrow(lean(merge), _RUN), "warc-run-list")


def merge_runs(runs: DataFrame) -> DataFrame:
    """The entries of all runs in global order: partition k of the result comes before k + 1, and rows
    within a partition are in order of URL key, time and id."""
    spark = runs.sparkSession
    total = runs.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    cuts = _ranges(runs, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ENTRIES)))
    while (count := runs.select("run").distinct().count()) > FAN:
        runs = _fewer(runs, cuts)
        if runs.select("run").distinct().count() >= count:
            raise ValueError("FAN is too small to merge anything")
    shared = spark.sparkContext.broadcast(cuts)
    tasks = _slices(runs, cuts).groupBy("range").agg(_listed())  # of FAN runs at most

    def merge(batches: Batches) -> Batches:
        for batch in batches:
            for place, slices in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                buffer: list[tuple] = []
                for e in _merged(slices, place, shared.value):
                    buffer.append(e)
                    if len(buffer) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buffer), _SCHEMA.types)], _SCHEMA.names)
                        buffer = []
                if buffer:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buffer), _SCHEMA.types)], _SCHEMA.names)

    return tasks.repartitionById(len(cuts) + 1, F.col("range")).mapInArrow(lean(merge), ENTRY)
