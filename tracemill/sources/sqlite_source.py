"""SQLite tables as a Spark data source: split by row ids, conditions handed to SQLite, written file by file.

    spark.dataSource.register(SQLiteSource)
    spark.read.format("sqlite").schema("file string, id string").option("table", "session").load(folder)

Files are opened where they lie, read-only, so the folder has to be one that driver and
executors share. A task holds some thousand rows, never a file.
"""

from __future__ import annotations

import fnmatch
import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Row ids of a partition, the least bytes of a file for each partition of it, and rows read at a time.
ROWS, BYTES, BATCH = 50_000, 1 << 20, 5_000
#: Name of the column that holds a row's file.
FILE = "file"


def local_path(path: str) -> str:
    """The place in the file system that a path or a file: URI names."""
    return unquote(urlsplit(path).path) if path.startswith("file:") and "%" in path else path.removeprefix("file://").removeprefix("file:")


def is_local(spark: SparkSession, path: str) -> bool:
    """Whether Python can open what the path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"


def files_of(path: str, glob: str) -> list[str]:
    """The files below a folder, hidden ones left out as Spark's readers do, or the one file."""
    path = os.path.abspath(local_path(path))
    if os.path.isfile(path):
        return [path]
    hidden = lambda n: n.startswith((".", "_"))
    out = []
    for folder, inner, names in os.walk(path):
        inner[:] = sorted(n for n in inner if not hidden(n))
        out += (os.path.join(folder, n) for n in sorted(names) if fnmatch.fnmatchcase(n, glob) and not hidden(n))
    return out


def opened(path: str) -> sqlite3.Connection:
    """A read-only connection; where the log of changes beside a file can't be used, to the file as it stands."""
    for how in ("mode=ro", "mode=ro&immutable=1"):
        con = sqlite3.connect(f"file:{quote(path)}?{how}", uri=True)
        try:
            con.execute("SELECT 1 FROM sqlite_master").fetchone()
            return con
        except sqlite3.OperationalError:
            con.close()
            if "immutable" in how:
                raise
        except sqlite3.DatabaseError:
            con.close()
            raise
    raise AssertionError


def _named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def affinities(con: sqlite3.Connection, table: str) -> dict[str, str]:
    """text, integer or other, by column: how SQLite stores what is put into it."""
    out = {}
    for _, name, kind, *_ in con.execute(f"PRAGMA table_xinfo({_named(table)})"):
        kind = (kind or "").upper()
        out[name] = "integer" if "INT" in kind else "text" if any(k in kind for k in ("CHAR", "CLOB", "TEXT")) else "other"
    return out


def _to(value: object, kind: T.DataType) -> object:
    """A stored value as the column's type; null if it isn't one."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else bytes(value).decode() if isinstance(value, bytes) else str(value)
        if isinstance(kind, T.BinaryType):
            return value if isinstance(value, bytes) else str(value).encode()
        if isinstance(kind, T.BooleanType):
            return bool(int(value))
        if isinstance(kind, T.IntegralType):
            return int(value)
        return float(value)
    except (ValueError, UnicodeDecodeError, OverflowError):
        return None


#: Comparisons that are handed down.
COMPARISONS = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


@dataclass
class Condition:
    """column op value, op being a comparison, `in` or `some` (not null)."""

    column: str
    op: str
    value: object = None

    def holds(self, v: object) -> bool:
        if v is None:
            return False
        match self.op:
            case "=":
                return v == self.value
            case "in":
                return v in self.value
            case "some":
                return True
            case ">":
                return v > self.value
            case ">=":
                return v >= self.value
            case "<":
                return v < self.value
            case _:
                return v <= self.value

    def sql(self, affinity: str) -> tuple[str, list] | None:
        """SQL and its values, where SQLite compares stored values as Spark compares the column's."""
        kinds = {type(v) for v in (self.value if self.op == "in" else [self.value])}
        if self.op == "some":
            return f"{_named(self.column)} IS NOT NULL", []
        if not (affinity == "text" and kinds == {str} and self.op in ("=", "in") or affinity == "integer" and kinds == {int}):
            return None
        if self.op == "in":
            return f"{_named(self.column)} IN ({', '.join('?' * len(self.value))})", list(self.value)
        return f"{_named(self.column)} {self.op} ?", [self.value]


@dataclass
class Range(D.InputPartition):
    """Row ids from low to high of a file's table; all rows without them."""

    file: str
    low: int | None = None
    high: int | None = None


def ranges(file: str, table: str, rows: int = ROWS, least_bytes: int = BYTES) -> list[Range]:
    """Equal ranges between the least and the greatest row id, which SQLite finds at the ends of the table's tree.

    No more ranges than the file has pieces of least_bytes, however far apart the ids lie. A
    table without row ids is one range; a file that is no database or lacks the table none.
    """
    try:
        con = opened(file)
    except sqlite3.DatabaseError:
        return []
    try:
        if not con.execute("SELECT 1 FROM sqlite_master WHERE name = ? AND type IN ('table', 'view')", [table]).fetchone():
            return []
        try:
            low, high = con.execute(f"SELECT (SELECT min(rowid) FROM {_named(table)}), (SELECT max(rowid) FROM {_named(table)})").fetchone()
        except sqlite3.OperationalError:
            return [Range(file)]
        if low is None:
            return []
        if not isinstance(low, int):  # A view's rowid is a column of any kind.
            return [Range(file)]
        span = high - low + 1
        n = max(1, min(-(-span // rows), os.path.getsize(file) // least_bytes))
        ends = [low + span * k // n for k in range(n + 1)]
        return [Range(file, a, b - 1) for a, b in zip(ends, ends[1:], strict=False)]
    except sqlite3.DatabaseError:
        return []
    finally:
        con.close()


class Reader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options, self.conditions = schema, options, []

    def pushFilters(self, filters: list[D.Filter]):  # noqa: N802
        """Takes the conditions that the option `push` names; the others stay with Spark.

        Spark keeps what one plan has handed down for the next plan over the same load(), so
        only conditions that every plan over it has may be taken: scan() sees to that.
        """
        wanted = [tuple(c) for c in json.loads(self.options.get("push", "[]"))]
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, D.In) and any(c[:2] == (name, "in") and set(c[2]) == set(f.value) for c in wanted):
                self.conditions.append(Condition(name, "in", tuple(f.value)))
            elif type(f) in COMPARISONS and ((name, COMPARISONS[type(f)], f.value) in wanted or isinstance(f, D.EqualTo) and (name, "in", [f.value]) in wanted):
                self.conditions.append(Condition(name, COMPARISONS[type(f)], f.value))
            elif isinstance(f, D.IsNotNull) and any(c[0] == name for c in wanted):
                self.conditions.append(Condition(name, "some"))
            else:
                yield f

    def partitions(self):
        files = files_of(self.options["path"], self.options.get("glob", "*"))
        found = [r for f in files for r in ranges(f, self.options["table"], int(self.options.get("rows", ROWS)), int(self.options.get("bytes", BYTES)))]
        # Spark asks for one partition at least.
        return found or [Range("")]

    def statement(self, con: sqlite3.Connection, part: Range) -> tuple[str, list] | None:
        """The SQL for a range, with the conditions that SQLite can be trusted with; None if a column is missing."""
        table, has = self.options["table"], affinities(con, self.options["table"])
        if any(f.name not in has and f.name != FILE and f.name.lower() != "rowid" for f in self.schema.fields):
            return None
        where, values = [], []
        if part.low is not None:
            where, values = ["rowid BETWEEN ? AND ?"], [part.low, part.high]
        for c in self.conditions:
            affinity = "integer" if c.column.lower() == "rowid" else has[c.column]
            if found := c.sql(affinity):
                where.append(found[0])
                values += found[1]
        names = ", ".join(_named(f.name) for f in self.schema.fields if f.name != FILE) or "1"
        return f"SELECT {names} FROM {_named(table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not part.file:
            return
        con, arrow = opened(part.file), to_arrow_schema(self.schema)
        fields, own = self.schema.fields, [f for f in self.schema.fields if f.name != FILE]
        place = {f.name: k for k, f in enumerate(own)}
        con.text_factory = lambda raw: raw.decode(errors="replace")
        try:
            if (asked := self.statement(con, part)) is None:
                return
            cursor = con.execute(*asked)
            while rows := cursor.fetchmany(BATCH):
                columns = [[_to(r[k], f.dataType) for r in rows] for k, f in enumerate(own)]
                keep = range(len(rows))
                for c in self.conditions:
                    keep = [k for k in keep if c.holds(columns[place[c.column]][k])]
                names = f"file:{part.file}"
                arrays = [pa.array([names] * len(keep) if f.name == FILE else [columns[place[f.name]][k] for k in keep], arrow.field(f.name).type) for f in fields]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        except sqlite3.DatabaseError:
            return
        finally:
            con.close()


@dataclass
class Written(D.WriterCommitMessage):
    temporary: str


class Writer(D.DataSourceArrowWriter):
    """Each task writes a file of its own under a temporary name; the files get their names when all are done."""

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.schema, self.table, self.overwrite = schema, options["table"], overwrite
        self.path = os.path.abspath(local_path(options["path"]))
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"_{self.run}-{uuid.uuid4().hex}.db")
        kind = lambda t: "INTEGER" if isinstance(t, (T.IntegralType, T.BooleanType)) else "REAL" if isinstance(t, T.FractionalType) else "BLOB" if isinstance(t, T.BinaryType) else "TEXT"
        con = sqlite3.connect(name)
        con.execute(f"CREATE TABLE {_named(self.table)} ({', '.join(f'{_named(f.name)} {kind(f.dataType)}' for f in self.schema.fields)})")
        for b in iterator:
            con.executemany(f"INSERT INTO {_named(self.table)} VALUES ({', '.join('?' * b.num_columns)})", zip(*(c.to_pylist() for c in b.columns), strict=True))
        con.commit()
        con.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        old = files_of(self.path, "*.db") if self.overwrite else []
        for m in messages:
            folder, name = os.path.split(m.temporary)
            os.replace(m.temporary, os.path.join(folder, name[1:]))
        for f in old:
            os.remove(f)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.temporary):
                os.remove(m.temporary)


class SQLiteSource(D.DataSource):
    """Options: path, table, glob (of file names), rows and bytes (of a partition). The schema is given; a column `file` is the row's file."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, dict(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SQLiteSource)
    return spark


def scan(spark: SparkSession, path: str, glob: str, table: str, schema: str, where: list[tuple[str, str, object]] | None = None) -> DataFrame:
    """file and some columns of a table in all SQLite files below a folder, by ranges of row ids.

    where has conditions on columns of text or whole numbers (column; `in`, or one of = > >= < <=
    where text knows = alone; value or values, none null) that Spark hands to SQLite. Other
    conditions on the result are Spark's. A file that is no database, or lacks the table or a
    column, gives no rows.
    """
    where = where or []
    found = registered(spark).read.format("sqlite").schema(f"{FILE} string, {schema}").option("glob", glob).option("table", table).option("push", json.dumps(where)).load(path)
    for column, op, value in where:
        c = found[column]
        if op == "in":
            found = found.where(c.isin(*value)) if value else found.where(F.lit(False))
        else:
            found = found.where({"=": c.__eq__, ">": c.__gt__, ">=": c.__ge__, "<": c.__lt__, "<=": c.__le__}[op](value))
    return found


def save(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """df as SQLite files, one of each partition."""
    registered(df.sparkSession)
    df.write.format("sqlite").mode(mode).option("table", table).save(path)
