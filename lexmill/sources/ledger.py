"""SQLite ledgers as DataFrames: ranges of rowids as tasks, conditions and columns given to SQLite, checked before they are read.

The path is a ledger or a folder of them (one for each writer), on a disk that the driver and all executors mount.  A ledger that
isn't there has no rows.  One task reads within one transaction; if there are several, each looks whether the file has changed
since the plan was made and fails if so, as their rows would not be of one time.  Columns that an older ledger lacks are null.

Conditions are named when the ledger is opened and not taken from Spark's pushed filters: Spark 4.1 keeps what one query pushed to
a Python source for the next query over the same frame, which would then lose rows.
"""

from __future__ import annotations

import json
import operator
import os
import sqlite3
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS = 4096
_TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "FLOAT": "double", "DOUBLE": "double", "BLOB": "binary"}
RELATIONS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class CorruptLedger(RuntimeError):
    pass


def local_path(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"SQLite can't open {path}: it needs a disk that all executors mount")
    return path.removeprefix("file://")


def _ledgers(path: str) -> list[str]:
    path = local_path(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".db"))
    return [path] if os.path.exists(path) else []


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _stamp(path: str) -> tuple:
    """Changes whenever the ledger or its log of writes does."""
    return tuple((s.st_mtime_ns, s.st_size) for p in (path, f"{path}-wal") if os.path.exists(p) for s in [os.stat(p)] if s.st_size)


def _condition(column: str, relation: str, value=None) -> tuple[str, list]:
    """A condition in SQLite's words, and its values."""
    if relation in ("is null", "is not null"):
        return f"{_quoted(column)} {relation.upper()}", []
    if relation == "in":
        return f"{_quoted(column)} IN ({', '.join('?' * len(value))})", list(value)
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation!r}")
    return f"{_quoted(column)} {relation} ?", [value]


def _kept(column: str, relation: str, value=None) -> Column:
    """The same condition in Spark, which looks again: a column's own collation may let more through."""
    if relation in ("is null", "is not null"):
        return F.col(column).isNull() if relation == "is null" else F.col(column).isNotNull()
    return F.col(column).isin(*value) if relation == "in" else RELATIONS[relation](F.col(column), value)


class Rows(ds.InputPartition):
    def __init__(self, path: str, first: int | None, last: int | None, stamp: tuple | None) -> None:
        self.path, self.first, self.last, self.stamp = path, first, last, stamp


class _Reader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns, self.options = schema.names, dict(options)

    def partitions(self) -> list[Rows]:
        table, parts, out = self.options["table"], int(self.options.get("partitions", 8)), []
        for path in _ledgers(self.options["path"]):
            before = _stamp(path)
            with _open(path) as db:
                if self.options.get("check", "true") == "true" and (said := db.execute("PRAGMA integrity_check(1)").fetchone()[0]) != "ok":
                    raise CorruptLedger(f"integrity check of {path} failed: {said}")
                if (wanted := self.options.get("version")) and (is_ := db.execute("PRAGMA user_version").fetchone()[0]) != int(wanted):
                    raise ValueError(f"{path} has schema version {is_}, not {wanted}")
                try:
                    first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
                except sqlite3.OperationalError as error:
                    if "rowid" not in str(error):
                        raise
                    out.append(Rows(path, None, None, None))  # a table without rowids is one range
                    continue
            if first is not None:
                step = -(-(last - first + 1) // parts)
                starts = range(first, last + 1, step)
                out += [Rows(path, s, min(s + step - 1, last), before if len(starts) > 1 else None) for s in starts]
        return out

    def read(self, partition: Rows | None) -> Iterator[tuple]:
        if partition is None:  # no ledger
            return
        with _open(partition.path) as db:
            there = {r[1] for r in db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})")}
            chosen = ", ".join(_quoted(c) if c in there else "NULL" for c in self.columns)
            # Where a column isn't there, Spark alone tells whether null will do.
            conditions = [_condition(*c) for c in json.loads(self.options.get("where", "[]")) if c[0] in there]
            if partition.first is not None:
                conditions = [*conditions, ("rowid BETWEEN ? AND ?", [partition.first, partition.last])]
            where = " AND ".join(f"({c})" for c, _ in conditions) or "1"
            rows = db.execute(f"SELECT {chosen} FROM {_quoted(self.options['table'])} WHERE {where}", [v for _, values in conditions for v in values])
            while some := rows.fetchmany(ROWS):
                yield from some
        if partition.stamp is not None and partition.stamp != _stamp(partition.path):
            raise RuntimeError(f"{partition.path} changed while it was read; read it with one partition")


class LedgerSource(ds.DataSource):
    """format("ledger") with path and table, and partitions (8), check (true) and version; a schema chooses columns."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        for path in _ledgers(self.options["path"]):
            with _open(path) as db:
                columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
            return ", ".join(f"`{c[1]}` {_TYPES.get(c[2].upper(), 'string')}" for c in columns)
        raise ValueError("a ledger that isn't there needs a schema")

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options)


def ledger(spark: SparkSession, path: str, table: str, schema: str | None = None, where: Sequence[tuple] = (), **options) -> DataFrame:
    """A table of a ledger, or the columns of it that schema names; where: conditions, all of which must hold, as (column, relation)
    with "is null" or "is not null", (column, "in", values) or (column, relation, value)."""
    spark.dataSource.register(LedgerSource)
    reader = spark.read.format("ledger").option("path", path).option("table", table)
    for key, value in options.items():
        reader = reader.option(key, str(value).lower() if isinstance(value, bool) else str(value))
    rows = (reader.schema(schema) if schema else reader).option("where", json.dumps([list(c) for c in where])).load()
    for condition in where:
        _condition(*condition)  # raises if there is no such relation
        rows = rows.where(_kept(*condition))
    return rows


def write_ledgers(df: DataFrame, folder: str, table: str) -> int:
    """df as ledgers in a folder, one for each task, each put in place whole; how many."""
    folder = local_path(folder)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "binary": "BLOB", "boolean": "INTEGER"}
    columns = ", ".join(f"{_quoted(c)} {kinds.get(kind, 'TEXT')}" for c, kind in df.dtypes)
    places = ", ".join("?" * len(df.columns))

    def write(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        context = TaskContext.get()
        path = f"{folder}/{context.partitionId():05d}.db"
        part = f"{path}.{context.taskAttemptId()}.part"
        with sqlite3.connect(part) as db:
            db.execute(f"CREATE TABLE {_quoted(table)} ({columns})")
            for batch in batches:
                db.executemany(f"INSERT INTO {_quoted(table)} VALUES ({places})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
        db.close()
        os.replace(part, path)
        yield batch_of(path)

    def batch_of(path: str):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"path": [path]})

    return df.mapInArrow(write, "path string").count()
