"""Keyed state that merges change in place of rewriting it: slots by the hash of the key, each in buckets by the key.

A state is a folder of versions.  A version is a small table that names a folder for each slot; a merge reads only the slots that
its rows fall into, joins them bucket by bucket, writes those slots anew and commits a version in which the others keep their
folders.  The state's side of the join is read as it lies (Spark's bucketed scan), so of a merge only the delta is shuffled, however
large the state is.  Versions are committed as in ``versions``: readers find a whole state, and of two merges that start from one
version one gets a Conflict.

Slots bound what a small delta rewrites, and buckets the size of one task; both are fixed when the state is made.  A hot key is one
row of the state; a delta in which a key is repeated must be reduced first (``merge.first_wins``), or ``changed`` raises.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.operators import merge
from lexmill.sources import versions

SLOT = "_slot"
_MANIFEST = "slot int, folder string, layout string"


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...]
    slots: int
    buckets: int
    schema: str


def _slot(keys: Sequence[str], slots: int) -> Column:
    # Another hash than that of Spark's buckets, or each slot would have few of them.
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def _write(rows: DataFrame, path: str, layout: Layout) -> str:
    """Writes rows (with their slots) in buckets; the folder, below path, that holds a folder for each slot."""
    spark, folder, name = rows.sparkSession, f"data/v-{uuid.uuid4().hex}", f"lexmill_{uuid.uuid4().hex}"
    rows.write.partitionBy(SLOT).bucketBy(layout.buckets, *layout.keys).option("path", f"{path}/{folder}").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the table is external: its files stay
    return folder


def _commit(spark: SparkSession, path: str, folders: dict[int, str], layout: Layout, base: int) -> versions.Version:
    said = json.dumps(asdict(layout))
    return versions.publish(spark.createDataFrame([(s, f, said) for s, f in sorted(folders.items())] or [(-1, "", said)], _MANIFEST).coalesce(1), f"{path}/manifest", base=base)


def _read(spark: SparkSession, path: str, number: int | None) -> tuple[int, dict[int, str], Layout]:
    """A version's number, the folder of each slot, and the layout; as many rows as there are slots come to the driver."""
    if number is None:
        number = max(versions.numbers(spark, f"{path}/manifest"), default=None)
        if number is None:
            raise FileNotFoundError(f"{path} has no state")
    rows = versions.current(spark, f"{path}/manifest", number).collect()
    layout = json.loads(rows[0].layout)
    return number, {r.slot: r.folder for r in rows if r.slot >= 0}, Layout(**layout | {"keys": tuple(layout["keys"])})


def _written_slots(spark: SparkSession, path: str, folder: str) -> list[int]:
    files, jvm = versions._files(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(jvm.Path(f"{path}/{folder}"))]
    return [int(n.split("=")[1]) for n in names if n.startswith(f"{SLOT}=")]


def create(rows: DataFrame, path: str, keys: Sequence[str], slots: int = 64, buckets: int = 64) -> versions.Version:
    """A state's first version.  Rows are dealt out by the key once, so each task writes one bucket."""
    layout = Layout(tuple(keys), slots, buckets, rows.schema.json())
    folder = _write(rows.withColumn(SLOT, _slot(keys, slots)).repartition(buckets, *keys), path, layout)
    return _commit(rows.sparkSession, path, {s: folder for s in _written_slots(rows.sparkSession, path, folder)}, layout, 0)


def _scan(spark: SparkSession, path: str, number: int, folders: dict[int, str], layout: Layout) -> DataFrame:
    """The state as a bucketed table whose partitions lie where the version says."""
    fields = StructType.fromJson(json.loads(layout.schema))
    name = f"lexmill_state_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{number}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        keys = ", ".join(f"`{k}`" for k in layout.keys)
        spark.sql(f"CREATE TABLE {name} ({columns}, {SLOT} INT) USING parquet PARTITIONED BY ({SLOT}) CLUSTERED BY ({keys}) INTO {layout.buckets} BUCKETS LOCATION '{path}/data'")
        if folders:
            parts = " ".join(f"PARTITION ({SLOT}={s}) LOCATION '{path}/{f}/{SLOT}={s}'" for s, f in folders.items())
            spark.sql(f"ALTER TABLE {name} ADD {parts}")
    return spark.table(name)


def state(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of a version (default: the last), bucketed by their keys: joins and aggregations by these need no shuffle."""
    number, folders, layout = _read(spark, path, number)
    return _scan(spark, path, number, folders, layout).drop(SLOT)


def changed(spark: SparkSession, path: str, delta: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame], base: int | None = None) -> versions.Version:
    """Commits make(state's rows, delta) for the slots that delta falls into, as the version after base (default: the last); make keeps
    keys and columns, and may add rows only of delta's keys."""
    number, folders, layout = _read(spark, path, base)
    columns = [f.name for f in StructType.fromJson(json.loads(layout.schema))]
    # The slots are at most layout.slots numbers.
    each = delta.select(*layout.keys).repartition(layout.buckets, *layout.keys).groupBy(*layout.keys).agg(F.count(F.lit(1)).alias("n"))
    found = each.groupBy(_slot(layout.keys, layout.slots).alias("slot")).agg(F.max("n").alias("n")).collect()
    if any(r.n > 1 for r in found):
        raise ValueError("delta has a key twice")
    touched = sorted(r.slot for r in found)
    old = _scan(spark, path, number, folders, layout).where(F.col(SLOT).isin(*touched) if touched else F.lit(False)).drop(SLOT)
    new = make(old, delta).select(*columns).withColumn(SLOT, _slot(layout.keys, layout.slots))
    folder = _write(new, path, layout)
    return _commit(spark, path, folders | {s: folder for s in _written_slots(spark, path, folder)}, layout, number)


def upsert(spark: SparkSession, path: str, delta: DataFrame, rules: dict[str, str], base: int | None = None) -> versions.Version:
    """``merge.upsert`` on the state's keys."""
    _, _, layout = _read(spark, path, base)
    return changed(spark, path, delta, lambda old, new: merge.upsert(old, new, layout.keys, rules), base)


def dealt(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows dealt out as the state's are, so that what follows by the keys, and a join with the state, moves neither again."""
    _, _, layout = _read(spark, path, None)
    return rows.repartition(layout.buckets, *layout.keys)


def absent(spark: SparkSession, path: str, delta: DataFrame) -> DataFrame:
    """The rows of delta whose key the state lacks."""
    _, _, layout = _read(spark, path, None)
    return delta.join(state(spark, path).select(*layout.keys), list(layout.keys), "left_anti")
