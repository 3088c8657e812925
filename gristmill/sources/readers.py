"""Logs of JSON lines and feed files as Spark data sources, for batches and streams.

A file is cut at byte offsets, so a large log is read by many tasks and a stream goes on from where it was: its
offset is the bytes of each file that are done. Paths must be in a folder that all executors share."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StringType, StructType

#: Bytes of a log that one task reads.
SPLIT = 32 << 20
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _files(path: str, ending: str) -> list[str]:
    """The files of a folder, in order; marks of writers and hidden files are none."""
    folder = _local(path)
    return sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(ending) and n[0] not in "._")


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _pieces(path: str, start: int, end: int) -> list[Piece]:
    return [Piece(path, a, min(a + SPLIT, end)) for a in range(start, end, SPLIT)]


def _value(x: object, kind: object) -> object:
    """A JSON value as a column has it; None where it doesn't fit."""
    try:
        if x is None:
            return None
        if isinstance(kind, StringType):
            return x if isinstance(x, str) else json.dumps(x)
        if isinstance(kind, (LongType, IntegerType)):
            return None if isinstance(x, bool) or int(x) != x else int(x)
        if isinstance(kind, (DoubleType, FloatType)):
            return None if isinstance(x, bool) else float(x)
        return x
    except (TypeError, ValueError):
        return None


def lines(piece: Piece, schema: StructType, filters: list[tuple[str, type, object]]) -> Iterator[tuple]:
    """The rows of the lines that begin in a piece. Blank lines and such as aren't JSON objects are left out."""
    with open(piece.path, "rb") as f:
        at = piece.start
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # a line that began before belongs to the piece before
        else:
            f.seek(0)
        while at < piece.end:
            raw = f.readline()
            if not raw:
                break
            at += len(raw)
            try:
                found = json.loads(raw)
            except ValueError:
                continue
            if not isinstance(found, dict):
                continue
            row = {field.name: _value(found.get(field.name), field.dataType) for field in schema.fields}
            if all(row[c] is not None and _TESTS[kind](row[c], v) for c, kind, v in filters):
                yield tuple(row[field.name] for field in schema.fields)


class LogReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Comparisons of a column with a value are tested as lines are read; the others are left to Spark."""
        names = set(self.schema.names)
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in names and isinstance(f.value, (str, int, float)):
                self.filters.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        return [p for path in _files(self.path, "") for p in _pieces(path, 0, os.path.getsize(path))] or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return lines(partition, self.schema, self.filters) if partition.path else iter(())


class LogStream(DataSourceStreamReader):
    """Offsets are the bytes done of each file. ``most_files`` new files at most are begun in a batch, 0 for all; a run
    over what is there, which Spark makes one batch of for sources in Python, then begins as many and no more."""

    def __init__(self, path: str, schema: StructType, most_files: int):
        self.path, self.schema, self.most_files, self.seen = path, schema, most_files, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        now = {os.path.basename(p): os.path.getsize(p) for p in _files(self.path, "")}
        fresh = [n for n in sorted(now) if n not in self.seen][: self.most_files or None]
        self.seen = {n: now[n] for n in now if n in self.seen or n in fresh}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.seen = self.seen or dict(end)
        folder = _local(self.path)
        return [p for n in sorted(end) for p in _pieces(os.path.join(folder, n), start.get(n, 0), end[n])] or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return lines(partition, self.schema, []) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        self.seen = {**end, **self.seen}


class JsonLog(DataSource):
    """``spark.read.format("json_log").schema(...).load(folder)``, or readStream with the option mostFiles."""

    @classmethod
    def name(cls) -> str:
        return "json_log"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> LogStream:  # noqa: N802
        return LogStream(self.options["path"], schema, int(self.options.get("mostfiles", 0)))


class FeedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Piece]:
        return [Piece(p, 0, 0) for p in _files(self.path, "")] or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        """The items of one feed, one at a time: a file that breaks off gives those before the break."""
        if not partition.path or not os.path.getsize(partition.path):
            return
        channel = None
        try:
            for event, e in ElementTree.iterparse(partition.path, events=("end",)):
                if e.tag == "title" and channel is None:
                    channel = (e.text or "").strip()
                if e.tag == "item":
                    get = lambda tag: (e.findtext(tag) or "").strip() or None  # noqa: B023, E731
                    try:
                        when = parsedate_to_datetime(get("pubDate") or "")
                    except (TypeError, ValueError):
                        when = None
                    if get("title"):
                        yield (get("title"), get("link"), when, get("source") or channel)
                    e.clear()
        except ElementTree.ParseError:
            return


class Feed(DataSource):
    """``spark.read.format("feed").load(folder)``: (title, link, published_at, source) of the items of feed files. Items
    without a title are left out; a date that can't be read is null; without a source the feed's title stands for it."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "title string, link string, published_at timestamp, source string"

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make both sources known to the session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonLog)
    spark.dataSource.register(Feed)
