"""Python data sources for spreadsheet (xlsx) and SQLite files, by the standard library."""

from __future__ import annotations

import re
import sqlite3
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats that show dates (fixed values of the file format).
_DATE_FORMATS = frozenset({14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47})


def _place(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def read_sheet(path: str) -> tuple[list[str], list[list]]:
    """Names and rows of the first sheet; its first row names the columns, without surrounding blanks."""
    with zipfile.ZipFile(path) as book:
        parts = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in parts:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates: list[bool] = []
        if "xl/styles.xml" in parts:
            styles = ElementTree.fromstring(book.read("xl/styles.xml"))
            own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in styles.iter(f"{_MAIN}numFmt")}
            shows = lambda k: k in _DATE_FORMATS or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, "")).lower()))
            cells = styles.find(f"{_MAIN}cellXfs")
            dates = [shows(int(x.get("numFmtId", 0))) for x in cells] if cells is not None else []
        first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets")[0].get(_REL)
        target = next(r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == first)
        sheet = ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows: list[dict[int, object]] = []
    for row in sheet.iter(f"{_MAIN}row"):
        found: dict[int, object] = {}
        for k, c in enumerate(row.iter(f"{_MAIN}c")):
            at, kind, v = _place(c.get("r")) if c.get("r") else k, c.get("t"), c.find(f"{_MAIN}v")
            if kind == "inlineStr":
                found[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif v is None or v.text is None or kind == "e":
                continue
            elif kind == "s":
                found[at] = shared[int(v.text)]
            elif kind == "str":
                found[at] = v.text
            elif kind == "b":
                found[at] = v.text == "1"
            else:
                number = float(v.text)
                style = int(c.get("s", 0))
                found[at] = datetime(1899, 12, 30) + timedelta(days=number) if style < len(dates) and dates[style] else int(number) if number.is_integer() else number
        rows.append(found)
    if not rows:
        return [], []
    width = max((max(r, default=-1) for r in rows), default=-1) + 1
    names = [str(rows[0].get(k, f"column{k}")).strip() for k in range(width)]
    return names, [[r.get(k) for k in range(width)] for r in rows[1:]]


def _kind(values: list):
    kinds = {type(v) for v in values if v is not None}
    if kinds == {int}:
        return LongType()
    if kinds and kinds <= {int, float}:
        return DoubleType()
    return {frozenset({bool}): BooleanType(), frozenset({datetime}): TimestampNTZType()}.get(frozenset(kinds), StringType())


def _fitted(rows: Iterable, schema: StructType) -> Iterator[tuple]:
    cast = [float if isinstance(f.dataType, DoubleType) else str if isinstance(f.dataType, StringType) else lambda v: v for f in schema]
    for r in rows:
        yield tuple(None if v is None else f(v) for f, v in zip(cast, r, strict=True))


class _Rows(DataSourceReader):
    def __init__(self, read, schema: StructType):
        self.rows, self.schema = read, schema

    def read(self, partition) -> Iterator[tuple]:
        return _fitted(self.rows()[1], self.schema)


class XlsxSource(DataSource):
    """First sheet of a spreadsheet; option path. A sheet has at most 1,048,576 rows, so one task reads it; types are those of all its values."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_xlsx"

    def schema(self) -> StructType:
        names, rows = read_sheet(self.options["path"])
        return StructType([StructField(n, _kind([r[k] for r in rows])) for k, n in enumerate(names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options["path"]
        return _Rows(lambda: read_sheet(path), schema)


def first_table(path: str) -> str:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        found = db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name LIMIT 1").fetchone()
    if not found:
        raise ValueError(f"no tables in {path}")
    return found[0]


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_schema(path: str, table: str) -> StructType:
    """By the kinds of values that each column has, counted inside SQLite; no row is fetched."""
    with _open(path) as db:
        names = [x[0] for x in db.execute(f"SELECT * FROM {_quoted(table)} LIMIT 0").description]
        fields = []
        for c in names:
            kinds = {r[0] for r in db.execute(f"SELECT DISTINCT typeof({_quoted(c)}) FROM {_quoted(table)}")} - {"null"}
            fields.append(StructField(c, LongType() if kinds == {"integer"} else DoubleType() if kinds and kinds <= {"integer", "real"} else StringType()))
    return StructType(fields)


@dataclass
class RowidRange(InputPartition):
    first: int | None = None
    last: int | None = None


class _SqliteReader(DataSourceReader):
    """Ranges of rowids are read side by side, row by row; a table without rowids is one range."""

    def __init__(self, path: str, table: str, schema: StructType, rows: int):
        self.path, self.table, self.schema, self.rows = path, table, schema, rows

    def partitions(self) -> list[RowidRange]:
        with _open(self.path) as db:
            try:
                first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [RowidRange()]
        if not isinstance(first, int) or not isinstance(last, int):
            return [RowidRange()]
        step = max(self.rows, (last - first) // 1000 + 1)
        return [RowidRange(k, min(last, k + step - 1)) for k in range(first, last + 1, step)]

    def read(self, partition: RowidRange) -> Iterator[tuple]:
        within = "" if partition.first is None else f" WHERE rowid BETWEEN {partition.first} AND {partition.last}"
        with _open(self.path) as db:
            yield from _fitted(db.execute(f"SELECT * FROM {_quoted(self.table)}{within}"), self.schema)


class SqliteSource(DataSource):
    """A table of a SQLite file; options path, table (default: the first by name) and rows (rowids of a partition, at least)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_sqlite"

    def _table(self) -> str:
        return self.options.get("table") or first_table(self.options["path"])

    def schema(self) -> StructType:
        return sqlite_schema(self.options["path"], self._table())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self._table(), schema, int(self.options.get("rows", 500_000)))
