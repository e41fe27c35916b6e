"""Logs that grow, followed as a stream: only what was appended is read.

The source's offset is a map of each file to the end of its last whole line and a stamp of
the bytes there. A file whose stamp no longer fits was cut or written anew: it is read from
its beginning behind a row that takes back what came from it before. A half line waits for
its end. Batches are kept in folders of their own, and current_lines() gives what a full
read of the logs would.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import translate
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.sources.sqlite_source import files_of, local_path
from tracemill.streaming.incremental import keep_batches, run_available

#: Bytes of a partition, bytes that a stamp covers at either end, bytes read at a time for the last line, and lines of an Arrow batch.
PIECE, STAMP, BACK, BATCH = 16 << 20, 256, 1 << 16, 2_000
SCHEMA = "file string, kind string, at long, line string"
#: Marks a folder of followed logs.
MARKER = "_followed"


def end_of_lines(path: str) -> int:
    """The place behind the last newline of a file, sought from its end."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            low = max(0, at - BACK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


def uri(path: str) -> str:
    """A file's name as Spark gives it beside the lines that it reads."""
    return "file:" + "".join(c if ord(c) > 127 else quote(c, safe="/_-!.~'()*,;:$&+=@") for c in path)


def stamp(path: str, size: int) -> int:
    """A checksum of the first and the last bytes of the part of a file up to size."""
    with open(path, "rb") as f:
        head = f.read(min(STAMP, size))
        f.seek(max(0, size - STAMP))
        return zlib.crc32(f.read(min(STAMP, size)), zlib.crc32(head))


@dataclass
class Pieces(D.InputPartition):
    """Rows to make: (file, low, high) for the lines that begin there, and (file, kind) for a file's change."""

    ranges: list[tuple[str, int, int]] = field(default_factory=list)
    changes: list[tuple[str, str]] = field(default_factory=list)


def pieces(start: dict, end: dict, most: int = PIECE) -> list[Pieces]:
    """What lies between two offsets, large files cut and small ones put together."""
    ranges, changes = [], [(f, "removed") for f in sorted(start) if f not in end]
    for f in sorted(end):
        low, high = 0, end[f][0]
        if f in start:
            known, mark = start[f]
            try:
                same = high >= known and stamp(f, known) == mark
            except FileNotFoundError:
                same = False
            if same:
                low = known
            else:
                changes.append((f, "reset"))
        ranges += [(f, a, min(a + most, high)) for a in range(low, high, most)]
    out, size = [Pieces([], changes)], 0
    for r in ranges:
        if size + r[2] - r[1] > most and out[-1].ranges:
            out.append(Pieces())
            size = 0
        out[-1].ranges.append(r)
        size += r[2] - r[1]
    return out


def lines_of(path: str, low: int, high: int) -> Iterator[tuple[int, str]]:
    """Place and text of the lines that begin from low to high; a file that is gone or shorter gives what is there."""
    try:
        f = open(path, "rb")
    except FileNotFoundError:
        return
    with f:
        if low:
            # A line that begins before low belongs to the piece before.
            f.seek(low - 1)
            f.readline()
        while (at := f.tell()) < high:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield at, line[:-1].removesuffix(b"\r").decode(errors="replace")


class Reader(D.DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.piece = int(options.get("piece", PIECE))
        #: What was seen of files that have not changed since: time, length, entry.
        self.seen: dict[str, tuple[int, int, list]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out, seen = {}, {}
        for f in files_of(self.path, self.glob):
            try:
                info = os.stat(f)
                old = self.seen.get(f)
                if old and old[:2] == (info.st_mtime_ns, info.st_size):
                    entry = old[2]
                else:
                    end = end_of_lines(f)
                    entry = [end, stamp(f, end)]
            except FileNotFoundError:
                continue
            out[f], seen[f] = entry, (info.st_mtime_ns, info.st_size, entry)
        self.seen = seen
        return out

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return pieces(start, end, self.piece)

    def read(self, part: Pieces) -> Iterator[pa.RecordBatch]:
        names = ["file", "kind", "at", "line"]
        if part.changes:
            yield pa.RecordBatch.from_arrays([pa.array([uri(f) for f, _ in part.changes]), pa.array([k for _, k in part.changes]), pa.nulls(len(part.changes), pa.int64()), pa.nulls(len(part.changes), pa.string())], names)
        for f, low, high in part.ranges:
            rows: list[tuple[int, str]] = []
            for row in lines_of(f, low, high):
                rows.append(row)
                if len(rows) == BATCH:
                    yield self._batch(uri(f), rows, names)
                    rows = []
            if rows:
                yield self._batch(uri(f), rows, names)

    @staticmethod
    def _batch(file: str, rows: list[tuple[int, str]], names: list[str]) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(["line"] * n), pa.array([a for a, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names)


class LogLines(D.DataSource):
    """Streaming source of lines. Options: path, glob (of file names), piece (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:  # noqa: N802
        return Reader(dict(self.options))


def stream(spark: SparkSession, path: str, glob: str = "*.jsonl", piece: int = PIECE) -> DataFrame:
    """file, kind, at, line: lines as they are appended, by place; kind `reset` or `removed` takes back all of a file's earlier lines.

    Files have to lie where driver and executors can open them. The offset grows with the
    number of files, not with their length.
    """
    spark.dataSource.register(LogLines)
    return spark.readStream.format("log_lines").option("glob", glob).option("piece", piece).load(os.path.abspath(local_path(path)))


def _file(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def is_followed(spark: SparkSession, path: str) -> bool:
    fs, place = _file(spark, f"{path}/{MARKER}")
    return fs.exists(place)


def follow(spark: SparkSession, logs: str, store: str, glob: str = "*.jsonl", piece: int = PIECE) -> StreamingQuery:
    """Brings a store up to date with its logs and ends. A batch that comes twice after a failure replaces itself."""
    out = run_available(stream(spark, logs, glob, piece), keep_batches(f"{store}/lines"), f"{store}/checkpoint")
    fs, place = _file(spark, f"{store}/{MARKER}")
    fs.create(place, True).close()
    return out


def _batches(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", batch_number long, batch int").parquet(f"{store}/lines").drop("batch")


def current_lines(spark: SparkSession, store: str, glob: str = "*") -> DataFrame:
    """file, at, line of the lines that the logs hold now; glob chooses among the files by name."""
    rows = _batches(spark, store).where(F.regexp_like(F.regexp_extract("file", "([^/]*)$", 1), F.lit(_java(glob))))
    since = rows.where("kind <> 'line'").groupBy("file").agg(F.max("batch_number").alias("since"))
    live = rows.where("kind = 'line'").join(since, "file", "left").where("since is null or batch_number >= since")
    return live.select("file", "at", "line")


def _java(glob: str) -> str:
    """A file name pattern as a regular expression that Java knows."""
    return "^" + re.sub(r"\(\?s:(.*)\)\\[zZ]$", r"\1", translate(glob)) + "$"


def touched(spark: SparkSession, store: str, since: int = -1) -> DataFrame:
    """file, kind (changed or removed) of the files that batches after `since` brought, as incremental.replaced() takes them."""
    rows = _batches(spark, store).where(F.col("batch_number") > since)
    last = rows.groupBy("file").agg(F.max(F.struct("batch_number", F.col("kind") != "removed")).alias("m"))
    return last.select("file", F.when(F.col("m")["col2"], "changed").otherwise("removed").alias("kind"))


def last_batch(spark: SparkSession, store: str) -> int:
    """The number of the newest batch, to be remembered for touched(); -1 without any."""
    n = _batches(spark, store).agg(F.max("batch_number")).first()[0]
    return -1 if n is None else n
