"""Spreadsheets (.xlsx), read and written with the standard library alone: a ZIP of XML files.

A sheet holds at most MOST_ROWS rows; a result of more goes on in further sheets of its workbook, which a custom property of the workbook
names, so that they are read as one. Tasks write pieces and read sheets, and none holds more than some rows. Cells are texts.
"""

from __future__ import annotations

import io
import itertools
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Mapping
from urllib.parse import quote
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import files
from .stitched import stitch

#: Rows of a sheet, by the format; rows of a piece, at most.
MOST_ROWS, PIECE_ROWS = 1_048_576, 1 << 16
#: Where custom properties are, and what the names of those that say which sheet a sheet continues begin with.
_PROPERTIES, _CONTINUES = "docProps/custom.xml", "continues: "
_LONG = 0xFFFFFFFF  # in a ZIP file, for a number that is in an extra field
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_NOT_XML = re.compile("[^\t\n\r\u0020-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_parts(file, sheet: str | None) -> list[str]:
    """The members of a workbook that hold a sheet by name, or the first one: its own and those of the sheets that continue it."""
    with zipfile.ZipFile(file) as z:
        names = set(z.namelist())
        sheets = {s.get("name"): s.get(_REL) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        continued = {}
        if _PROPERTIES in names:
            continued = {p.get("name").removeprefix(_CONTINUES): "".join(p.itertext()) for p in ElementTree.fromstring(z.read(_PROPERTIES)) if p.get("name", "").startswith(_CONTINUES)}
        first = sheet if sheet is not None else next(iter(sheets))
        wanted = [targets[sheets[n]] for n in [first, *(n for n in sheets if n != first and continued.get(n) == first)]]
        return [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in wanted]


def part_rows(file, member: str) -> Iterator[list[str | None]]:
    """The rows of one member; what was read of it is not kept."""
    with zipfile.ZipFile(file) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        with z.open(member) as f:
            data = None
            for event, row in ElementTree.iterparse(f, ("start", "end")):
                if row.tag == f"{_MAIN}sheetData":
                    data = row
                if event == "start" or row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str | None] = {}
                for k, c in enumerate(row.iter(f"{_MAIN}c")):
                    v = c.find(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is None or v.text is None:
                        text = None
                    else:
                        text = strings[int(v.text)] if c.get("t") == "s" else v.text
                    cells[_column(c.get("r")) if c.get("r") else k] = text
                yield [cells.get(k) for k in range(max(cells, default=-1) + 1)]
                data.clear()


def sheet_rows(content: bytes, sheet: str | None) -> Iterator[list[str | None]]:
    """The rows of a sheet by name, or of the first one; the header once."""
    for k, member in enumerate(sheet_parts(io.BytesIO(content), sheet)):
        yield from itertools.islice(part_rows(io.BytesIO(content), member), 1 if k else 0, None)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet as text columns, named by its first row; the first sheet if none is named. Sheets that continue it belong to it, and are read by
    tasks of their own, as streams."""
    books = files.whole_files(spark, path)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_file(place, content) as f:
                    members = sheet_parts(f, sheet)
                    header = next(part_rows(f, members[0]), None)
                yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([content is None]), pa.array([members]), pa.array([header], pa.list_(pa.string()))], ["path", "streams", "members", "header"])

    # Names of members and headers alone go to the driver.
    listed = books.mapInArrow(parts, "path string, streams boolean, members array<string>, header array<string>").collect()

    def rows(place: str, content: bytes | None, member: str) -> Iterator[pa.RecordBatch]:
        with files.open_file(place, content) as f:
            read = itertools.islice(part_rows(f, member), 1, None)
            while part := list(itertools.islice(read, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], ["cells"])

    if all(b.streams for b in listed):
        todo = [(b.path, member) for b in listed for member in b.members]

        def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield from rows(todo[k][0], None, todo[k][1])

        cells = spark.range(0, len(todo), 1, max(1, min(len(todo), 10_000))).mapInArrow(of_parts, "cells array<string>")
    else:

        def of_books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for place, content in zip(*(c.to_pylist() for c in batch.columns)):
                    for member in sheet_parts(io.BytesIO(content), sheet):
                        yield from rows(place, content, member)

        cells = books.mapInArrow(of_books, "cells array<string>")
    header = next((b.header for b in listed if b.header is not None), [])
    names = [h if h else f"column{k + 1}" for k, h in enumerate(header)]
    return cells.select(*[F.get("cells", F.lit(k)).alias(name) for k, name in enumerate(names)])


def domain_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Domains from the first sheet: the column domain if there is one, else the first; no blank ones."""
    df = read_xlsx(spark, path)
    c = "domain" if "domain" in df.columns else df.columns[0]
    return df.select(F.col(f"`{c}`").alias("domain")).where(F.trim("domain") != "")


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{0}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{0}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_ROOT = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{0}</Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{0}</sheets></workbook>'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


_CUSTOM = '<?xml version="1.0" encoding="UTF-8"?><Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/custom-properties" xmlns:vt="http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes">{0}</Properties>'
_CUSTOM_TYPE = f'<Override PartName="/{_PROPERTIES}" ContentType="application/vnd.openxmlformats-officedocument.custom-properties+xml"/>'
_HEAD = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
_TAIL = "</sheetData></worksheet>"


def _row(cells: list[str | None]) -> str:
    return f"<row>{''.join('<c/>' if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", v))}</t></is></c>' for v in cells)}</row>"


def _packed(text: str, last: bool) -> tuple[bytes, int, int]:
    """Text as a piece of a member: deflated up to a whole byte, its CRC and its length before."""
    data, deflate = text.encode(), zlib.compressobj(wbits=-15)
    return deflate.compress(data) + deflate.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH), zlib.crc32(data), len(data)


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32; the highest bit is the constant."""
    product = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            product ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return product


def _crc_of_both(first: int, second: int, length: int) -> int:
    """The CRC-32 of two pieces one after another, the second of ``length`` bytes."""
    power, square = 1 << 31, 1 << 23  # 1, and x to the power 8: a byte
    while length:
        if length & 1:
            power = _times(power, square)
        square, length = _times(square, square), length >> 1
    return _times(power, first) ^ second


def _archive(members: Iterable[tuple[str, list[tuple[bytes | str, int, int, int]]]]) -> Iterator[bytes | str]:
    """The pieces of a ZIP file of members, each made of pieces (bytes or the path of a file; CRC, length and deflated length)."""
    at, directory, count = 0, [], 0
    for name, pieces in members:
        info = zipfile.ZipInfo(name)
        info.compress_type, info.CRC = zipfile.ZIP_DEFLATED, 0
        for _, crc, length, _ in pieces:
            info.CRC = _crc_of_both(info.CRC, crc, length)
        info.file_size, info.compress_size, info.header_offset = sum(p[2] for p in pieces), sum(p[3] for p in pieces), at
        head = info.FileHeader()
        yield head
        yield from (p[0] for p in pieces)
        at, count = at + len(head) + info.compress_size, count + 1
        sizes = (info.file_size, info.compress_size, info.header_offset)
        long = [n for n in sizes if n > zipfile.ZIP64_LIMIT]
        extra = struct.pack(f"<HH{len(long)}Q", 1, 8 * len(long), *long) if long else b""
        size, packed, offset = (_LONG if n > zipfile.ZIP64_LIMIT else n for n in sizes)
        version = 45 if long else 20
        directory.append(struct.pack("<4s6H3L5H2L", b"PK\1\2", version, version, 0, info.compress_type, 0, 33, info.CRC, packed, size, len(name), len(extra), 0, 0, 0, 0, offset) + name.encode() + extra)
    listed = b"".join(directory)
    end = b""
    if at > zipfile.ZIP64_LIMIT or count >= 0xFFFF:
        end = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, len(listed), at) + struct.pack("<4sLQL", b"PK\6\7", 0, at + len(listed), 1)
    number = min(count, 0xFFFF)
    yield listed + end + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, number, number, len(listed), min(at, _LONG), 0)


def _sheets(names: list[str], counts: Mapping[int, list[int]]) -> list[tuple[str, str | None, int, list[int]]]:
    """Name, name of the sheet that it continues, frame and numbers of its pieces: a frame of more rows than a sheet holds goes on in further
    sheets behind it. ``counts`` are the rows of each frame's pieces."""
    out, used = [], {n[:31].lower() for n in names}
    for k, name in enumerate(names):
        out.append((name[:31], None, k, []))
        rows, number = 1, 1
        for piece, count in enumerate(counts.get(k, [])):
            if rows + count > MOST_ROWS:
                while True:
                    number += 1
                    further = f"{name[: 31 - len(f' ({number})')]} ({number})"
                    if further.lower() not in used:
                        break
                used.add(further.lower())
                out.append((further, name[:31], k, []))
                rows = 1
            out[-1][3].append(piece)
            rows += count
    return out


def write_xlsx(path: str, sheets: Mapping[str, DataFrame], order: str | None = None) -> None:
    """A workbook with a sheet for each frame, and further sheets, (2), (3) and so on, where one would be too long; read_xlsx() takes them as one.
    Tasks write the rows of their partitions as deflated pieces, to a path that pyarrow opens; the driver's JVM puts these together. ``order`` is a
    column that rows are sorted by, where a frame has it."""
    names, columns = list(sheets), [df.columns for df in sheets.values()]
    all_rows = None
    for k, df in enumerate(sheets.values()):
        df = df.orderBy(F.col(order).cast("string")) if order and order in df.columns else df
        body = df.select(F.lit(k).alias("sheet"), F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("cells"))
        all_rows = body if all_rows is None else all_rows.union(body)
    spark = all_rows.sparkSession
    place, fs = files._hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    work = fs.makeQualified(place).toString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        store, inner = pafs.FileSystem.from_uri(quote(work, "/:@")) if "://" in work else (pafs.LocalFileSystem(), work.removeprefix("file:"))
        rows = ((s, c) for b in batches for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        number = 0
        for sheet, own in itertools.groupby(rows, lambda r: r[0]):
            while first := next(own, None):
                name, crc, length, count = uuid.uuid4().hex, 0, 0, 0
                deflate = zlib.compressobj(wbits=-15)
                piece = itertools.chain([first], itertools.islice(own, min(PIECE_ROWS, MOST_ROWS - 1) - 1))
                with store.open_output_stream(f"{inner}/{name}", compression=None) as f:
                    while some := [_row(c) for _, c in itertools.islice(piece, 1000)]:
                        data = "".join(some).encode()
                        crc, length, count = zlib.crc32(data, crc), length + len(data), count + len(some)
                        f.write(deflate.compress(data))
                    f.write(deflate.flush(zlib.Z_FULL_FLUSH))
                    packed = f.tell()
                yield pa.RecordBatch.from_pydict({"sheet": [sheet], "task": [TaskContext.get().partitionId()], "number": [number], "name": [name], "rows": [count], "crc": [crc], "length": [length], "packed": [packed]})
                number += 1

    try:
        fs.mkdirs(place)
        found = sorted(all_rows.mapInArrow(write, "sheet long, task long, number long, name string, rows long, crc long, length long, packed long").collect(), key=lambda r: (r.sheet, r.task, r.number))
        pieces = {k: list(g) for k, g in itertools.groupby(found, lambda r: r.sheet)}
        stitch(spark, work, _archive(_members(_sheets(names, {k: [p.rows for p in g] for k, g in pieces.items()}), columns, pieces, work)), path)
    finally:
        fs.delete(place, True)


def _members(parts, columns: list[list[str]], pieces: Mapping[int, list[Row]], work: str) -> Iterator[tuple[str, list[tuple[bytes | str, int, int, int]]]]:
    def one(text: str, last: bool) -> tuple[bytes, int, int, int]:
        data, crc, length = _packed(text, last)
        return data, crc, length, len(data)

    further = [(name, of) for name, of, _, _ in parts if of is not None]
    n = range(1, len(parts) + 1)
    yield "[Content_Types].xml", [one(_TYPES.format("".join(_SHEET_TYPE.format(k) for k in n) + (_CUSTOM_TYPE if further else "")), True)]
    custom = f'<Relationship Id="rId2" Type="{_OFFICE}/custom-properties" Target="{_PROPERTIES}"/>' if further else ""
    yield "_rels/.rels", [one(_ROOT.format(f'<Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/>{custom}'), True)]
    yield "xl/_rels/workbook.xml.rels", [one(_ROOT.format("".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n)), True)]
    yield "xl/workbook.xml", [one(_BOOK.format("".join(f'<sheet name={quoteattr(p[0])} sheetId="{k}" r:id="rId{k}"/>' for k, p in zip(n, parts))), True)]
    if further:
        properties = (f'<property fmtid="{{D5CDD505-2E9C-101B-9397-08002B2CF9AE}}" pid="{k + 2}" name={quoteattr(_CONTINUES + name)}><vt:lpwstr>{escape(of)}</vt:lpwstr></property>' for k, (name, of) in enumerate(further))
        yield _PROPERTIES, [one(_CUSTOM.format("".join(properties)), True)]
    for k, (_, _, sheet, own) in zip(n, parts):
        rows = [pieces[sheet][p] for p in own]
        yield f"xl/worksheets/sheet{k}.xml", [one(_HEAD + _row(columns[sheet]), False), *((f"{work}/{r.name}", r.crc, r.length, r.packed) for r in rows), one(_TAIL, True)]


def write_result_book(path: str, results: DataFrame, statistics: DataFrame, positive: DataFrame, kind: str = "malicious") -> None:
    """The workbook of a detection: results, statistics, and the positive rows, if there are any."""
    # What the sheets are called.
    first, last = {"malicious": ("预测结果", "恶意域名列表"), "impersonation": ("检测结果", "钓鱼域名列表")}[kind]
    sheets = {first: results, "统计信息": statistics}
    write_xlsx(path, sheets if positive.isEmpty() else sheets | {last: positive})
