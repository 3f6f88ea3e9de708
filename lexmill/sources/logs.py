"""Looking back from the end of append-only logs: only the blocks that can hold what is asked for are read.

A log is a file of lines, or a folder of such files, whose stamps don't fall but for `late` seconds.  The plan looks at the
first stamp of a few blocks of each file (a binary search) and drops those before the window; files that weren't written since it
began are dropped by their time.  Each block is a task of its own; lines belong to the block they begin in.  The store may be any
that pyarrow opens by its address.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexmill.sources import files

BLOCK, STEP = 8 << 20, 1 << 16


class Block(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def _store(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (stores.LocalFileSystem(), path)


def _logs(path: str) -> tuple[stores.FileSystem, list[stores.FileInfo]]:
    """The store, and the files of a path in order of their names; a path that isn't there has none."""
    store, at = _store(path)
    info = store.get_file_info(at)
    found = store.get_file_info(stores.FileSelector(at, recursive=True)) if info.type == stores.FileType.Directory else [info]
    return store, sorted((f for f in found if f.type == stores.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)


def _pieces(file, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in a block, in pieces of whole lines."""
    at, carry = max(start - 1, 0), b""
    file.seek(at)
    skip = start > 0
    while True:
        data = file.read(STEP)
        carry += data
        if skip:  # what begins before the block is another's
            cut = carry.find(b"\n")
            if cut < 0 and data:
                at, carry = at + len(carry), b""
                continue
            at, carry, skip = at + cut + 1, carry[cut + 1 :] if cut >= 0 else b"", False
        if at >= end:
            return
        cut = carry.rfind(b"\n") + 1 if data else len(carry)
        if at + cut > end and data:  # the last line that begins in the block ends at the first break from its end on
            edge = carry.find(b"\n", max(end - 1 - at, 0)) + 1
            if edge:
                yield carry[:edge]
                return
            continue
        if cut:
            yield carry[:cut]
            at, carry = at + cut, carry[cut:]
        if not data:
            return


def _stamp(line: bytes) -> datetime | None:
    try:
        said = json.loads(line).get("ts")
        when = datetime.fromisoformat(said) if said else None
    except (ValueError, AttributeError, TypeError):
        return None
    return when.replace(tzinfo=when.tzinfo or UTC) if when else None


def _first_stamp(file, start: int, size: int) -> datetime | None:
    """The first stamp of a line that begins at start or later."""
    for piece in _pieces(file, start, size):
        for line in piece.split(b"\n"):
            if when := _stamp(line):
                return when
    return None


def _window(store: stores.FileSystem, info: stores.FileInfo, cutoff: datetime, block: int) -> list[Block]:
    with store.open_input_file(info.path) as file:
        low, high = 0, -(-info.size // block)  # blocks before low begin before the cutoff, those from high on don't
        while low < high:
            middle = (low + high) // 2
            when = _first_stamp(file, middle * block, info.size)
            low, high = (middle + 1, high) if when is not None and when < cutoff else (low, middle)
    first = max(low - 1, 0)  # the last block that begins before the cutoff may reach over it
    return [Block(info.path, start, min(start + block, info.size)) for start in range(first * block, info.size, block)]


def _last_lines(store: stores.FileSystem, info: stores.FileInfo, lines: int) -> Block:
    """The end of a file with at least so many lines."""
    with store.open_input_file(info.path) as file:
        at, breaks = info.size, 0
        while at > 0 and breaks <= lines:
            step = min(STEP, at)
            at -= step
            file.seek(at)
            breaks += file.read(step).count(b"\n")
    return Block(info.path, at, info.size)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Block]:
        store, logs = _logs(self.options["path"])
        if "lines" in self.options:
            return [_last_lines(store, f, int(self.options["lines"])) for f in logs if f.size]
        late = timedelta(seconds=float(self.options.get("late", 0)))
        cutoff = datetime.fromisoformat(self.options["cutoff"])
        cutoff = cutoff.replace(tzinfo=cutoff.tzinfo or UTC) - late
        written = [f for f in logs if f.size and (f.mtime is None or f.mtime >= cutoff)]
        return [b for f in written for b in _window(store, f, cutoff, int(self.options.get("block", BLOCK)))]

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no block at all
            return
        store, _ = _store(self.options["path"])
        name = partition.path.rpartition("/")[2]
        with store.open_input_file(partition.path) as file:
            at = 0
            for piece in _pieces(file, partition.start, partition.end):
                lines = piece.decode("utf-8", "replace").removesuffix("\n").split("\n")
                places = range(at, at + len(lines))
                at += len(lines)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array([partition.start] * len(lines), pa.int64()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], names=["file", "block", "line", "value"])


class LogSource(DataSource):
    """format("log_end") with path and either cutoff (ISO time; late: seconds, block: bytes) or lines."""

    @classmethod
    def name(cls) -> str:
        return "log_end"

    def schema(self) -> str:
        return "file string, block bigint, line bigint, value string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def _read(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(LogSource)
    reader = spark.read.format("log_end")
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def look_back(spark: SparkSession, path: str, cutoff: datetime, late: float = 0, block: int = BLOCK) -> DataFrame:
    """The events of a JSON-lines log from the cutoff on.  Lines that are no objects, and rows without a stamp, go."""
    lines = _read(spark, path=path, cutoff=cutoff.isoformat(), late=late, block=block)
    return lines.select(F.from_json("value", files.EVENT, {"mode": "PERMISSIVE"}).alias("e")).select("e.*").where(F.col("ts") >= F.lit(cutoff))


def tail(spark: SparkSession, path: str, lines: int) -> DataFrame:
    """(position, line) of the last lines of a log file; positions rise and say nothing else.  At most so many lines come together."""
    rows = _read(spark, path=path, lines=lines).orderBy(F.desc("file"), F.desc("block"), F.desc("line")).limit(lines)
    return rows.select(F.col("line").alias("position"), F.col("value").alias("line"))
