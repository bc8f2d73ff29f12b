"""Tables in files: CSV by header, workbooks of XML in ZIP, and SQLite databases; read in parallel, never inferred."""

from __future__ import annotations

import re
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.places import zip_key


def csv_table(spark: SparkSession, path: str, wanted: list[str], sep: str = ",", optional: list[str] = ()) -> DataFrame:
    """The wanted columns of a CSV file as text, found by their names in its header, whatever their case and order.

    Quoted fields may hold separators, quotes and line ends. A wanted column that is missing is an error; an optional one is
    null.
    """
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)
    by_name = {c.strip().lower(): c for c in df.columns}
    missing = [w for w in wanted if w not in by_name]
    if missing:
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    some = [F.col(f"`{by_name[w]}`").alias(w) if w in by_name else F.lit(None).cast("string").alias(w) for w in (*wanted, *optional)]
    return df.select(*some)


def zip_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(zip_key, city, state, latitude, longitude) of tables of codes; rows without coordinates go, the first of a key stays."""
    parts = []
    for n, path in enumerate(paths):
        df = csv_table(spark, path, ["zip", "city", "state", "latitude", "longitude"], optional=["country"])
        point = [F.col(c).try_cast("double").alias(c) for c in ("latitude", "longitude")]
        parts.append(df.select(F.lit(n).alias("turn"), zip_key(F.col("zip"), F.col("country"), F.col("state")).alias("zip_key"), "city", "state", *point))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = df.filter("zip_key is not null and latitude is not null and longitude is not null")
    return df.groupBy("zip_key").agg(F.min_by(F.struct("city", "state", "latitude", "longitude"), F.struct("turn", "city")).alias("b")).select("zip_key", "b.*")


def curated_offices(spark: SparkSession, path: str) -> DataFrame:
    """Offices that were added by hand; rows of an unknown type go."""
    df = csv_table(spark, path, ["ticker", "type", "label", "street", "city", "zip"], optional=["note"])
    return df.filter(F.lower("type").isin("headquarters", "campus", "office", "plant"))


def employer_aliases(spark: SparkSession, path: str) -> DataFrame:
    return csv_table(spark, path, ["employer", "ticker"], optional=["note"]).filter("employer <> '' and ticker <> ''").select("employer", "ticker")


def constituents(spark: SparkSession, path: str) -> DataFrame:
    """Members of an index; without an identifier they are matched by name."""
    return csv_table(spark, path, ["ticker", "name", "sector"], optional=["lei"]).withColumn("lei", F.nullif(F.trim("lei"), F.lit("")))


def gazetteer(spark: SparkSession, path: str, columns: dict[str, int], sep: str = "\t") -> DataFrame:
    """A table without a header: columns by their place in a line."""
    part = F.split("value", re.escape(sep))
    return spark.read.text(path).select(*[F.trim(F.get(part, F.lit(i))).alias(n) for n, i in columns.items()])


def number(cell: Column) -> Column:
    """A figure in a cell: without currency signs and thousands' commas."""
    return F.regexp_replace(cell, r"[$€£,\s]", "").try_cast("decimal(28,4)")


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df, text columns, as kinds (int, decimal, date, text, or values a|b|c whatever their case and spaces), with problems:
    the names of columns whose text is no such value. Blank rows go."""
    cells = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in kinds}
    out, problems = [], []
    for c, kind in kinds.items():
        cell = cells[c]
        if kind == "int":
            value = number(cell).cast("int")
        elif kind == "decimal":
            value = number(cell)
        elif kind == "date":
            serial = F.date_add(F.lit("1899-12-30").cast("date"), F.when(cell.rlike(r"^\d{4,6}$"), cell.try_cast("int")))
            value = F.coalesce(F.when(cell.rlike(r"^\d{4}-\d\d?-\d\d?$"), cell.try_cast("date")), serial)
        elif "|" in kind:
            bare = F.lower(F.regexp_replace(cell, r"\s", ""))
            value = F.coalesce(*[F.when(bare == v.lower(), v) for v in kind.split("|")])
        else:
            value = cell
        out.append(value.alias(c))
        problems.append(F.when(cell.isNotNull() & value.isNull(), c))
    blank = F.coalesce(*cells.values()).isNull()
    return df.filter(~blank).select(*out, F.array_compact(F.array(*problems)).alias("problems"))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class _Part(InputPartition):
    def __init__(self, path: str, first: int = 0, last: int = 0):
        super().__init__(path)
        self.path, self.first, self.last = path, first, last


def _column(cell: str) -> int:
    """A: 0, B: 1, ..., AA: 26."""
    n = 0
    for c in cell:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(path: str, sheet: str | None) -> Iterator[list[str | None]]:
    """The rows of a sheet (the first if it has no name) as lists of texts, read element by element."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == _MAIN + "si":
                        shared.append("".join(t.text or "" for t in e.iter(_MAIN + "t")))
                        e.clear()
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = [s for s in book.iter(_MAIN + "sheet") if sheet is None or (s.get("name") or "").lower() == sheet.lower()]
        if not found:
            return
        target = targets[found[0].get(_REL + "id")].lstrip("/")
        with z.open(target if target.startswith("xl/") else "xl/" + target) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != _MAIN + "row":
                    continue
                cells: list[str | None] = []
                for c in row:
                    at = _column(c.get("r") or "") if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value = c.find(_MAIN + "v")
                    text = "".join(t.text or "" for t in c.iter(_MAIN + "t")) if c.get("t") == "inlineStr" else None if value is None else value.text
                    cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                yield cells
                row.clear()


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.paths, self.sheet = schema, options["paths"].split("|"), options.get("sheet")

    def partitions(self):
        return [_Part(p) for p in self.paths]

    def read(self, partition):
        rows = sheet_rows(partition.path, self.sheet)
        header = [(h or "").strip().lower() for h in next(rows, [])]
        wanted = self.schema.names
        missing = [w for w in wanted if w.lower() not in header]
        if missing:
            raise ValueError(f"{partition.path} lacks columns: {', '.join(missing)}")
        places = [header.index(w.lower()) for w in wanted]
        for cells in rows:
            yield tuple(cells[i] if i < len(cells) else None for i in places)


class Workbooks(DataSource):
    """spark.read.format("workbook"): the columns of a schema of strings from workbooks (option paths, separated by bars; sheet
    by name), one task for each file. Missing columns are an error."""

    @classmethod
    def name(cls):
        return "workbook"

    def reader(self, schema):
        return WorkbookReader(schema, self.options)


class SqliteReader(DataSourceReader):
    """Tables are cut by row numbers, so that tasks read ranges of them and only the columns asked for."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.rows = int(options.get("rows", 100_000))
        if not re.fullmatch(r"\w+", self.table):
            raise ValueError(f"no table name: {self.table}")

    def _open(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._open() as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if low is None:
            return [_Part(self.path, 0, -1)]
        return [_Part(self.path, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]

    def read(self, partition):
        columns = ", ".join(f'"{c}"' for c in self.schema.names if c != "row_ord")
        with self._open() as db:
            query = f"SELECT {columns}{', rowid' if 'row_ord' in self.schema.names else ''} FROM {self.table} WHERE rowid BETWEEN ? AND ? ORDER BY rowid"
            yield from db.execute(query, (partition.first, partition.last))


class Sqlite(DataSource):
    """spark.read.format("sqlite_table"): a table of a database file (options path, table, rows a task); a last column row_ord
    is the row's number."""

    @classmethod
    def name(cls):
        return "sqlite_table"

    def reader(self, schema):
        return SqliteReader(schema, self.options)


def register(spark: SparkSession) -> None:
    for source in (Workbooks, Sqlite):
        spark.dataSource.register(source)


def union_workbooks(spark: SparkSession, paths: list[str], sheet: str, columns: list[str]) -> DataFrame:
    """One sheet of all the workbooks that there are."""
    register(spark)
    from pathlib import Path

    there = [p for p in paths if Path(p).exists()]
    schema = ", ".join(f"{c} string" for c in columns)
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.format("workbook").schema(schema).option("paths", "|".join(there)).option("sheet", sheet).load()
