"""Tables published as numbered versions: each commit names the next number, or fails if another writer has it.

A version's rows are written beside the others first; then its pointer, written whole under another name, is moved to
``_versions/<number>`` without overwriting.  So a reader always finds the last version that was committed, a crash leaves at most
a folder that nothing names, and of two writers who start from one version one gets a Conflict that names the other's.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer committed the version that was to be written."""

    def __init__(self, path: str, other: Version) -> None:
        super().__init__(f"{path}: version {other.number} was committed by another writer as {other.folder}")
        self.other = other


@dataclass(frozen=True)
class Version:
    """folder lies below the table's path; batch is the last batch of a stream that went in, if one did."""

    number: int
    folder: str
    schema: str
    batch: int | None = None


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _pointer(path: str, number: int) -> str:
    return f"{path}/_versions/{number:020d}"


def read_version(spark: SparkSession, path: str, number: int) -> Version:
    files, jvm = _files(spark, path)
    stream = files.open(jvm.Path(_pointer(path, number)))
    try:
        return Version(**json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all committed versions, in order."""
    files, jvm = _files(spark, path)
    folder = jvm.Path(f"{path}/_versions")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def latest(spark: SparkSession, path: str) -> Version | None:
    known = numbers(spark, path)
    return read_version(spark, path, known[-1]) if known else None


def _claim(spark: SparkSession, path: str, version: Version) -> bool:
    """Moves a pointer to its number; whether that was still free."""
    files, jvm = _files(spark, path)
    temporary, pointer = jvm.Path(f"{path}/_versions/.{uuid.uuid4().hex}"), jvm.Path(_pointer(path, version.number))
    out = files.create(temporary, True)
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()
    try:
        if files.getScheme() == "file":  # a link is made at once or not at all; Hadoop's local rename looks first and moves then
            os.link(temporary.toUri().getPath(), pointer.toUri().getPath())
        else:
            options = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
            options[0] = getattr(jvm, "Options$Rename").NONE
            jvm.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, pointer, options)
            return True
    except FileExistsError:
        return False
    except Exception as error:  # py4j wraps Java's exceptions
        if "FileAlreadyExists" not in str(error):
            raise
        return False
    finally:
        files.delete(temporary, False)
    return True


def publish(df: DataFrame, path: str, by: list[str] | None = None, format: str = "parquet", base: int | None = None, batch: int | None = None) -> Version:
    """Commits df as the version after base (the number that df was made from; default: the last one as the writing begins)."""
    spark = df.sparkSession
    if base is None:
        base = max(numbers(spark, path), default=0)
    version = Version(base + 1, f"data/v-{uuid.uuid4().hex}", df.schema.json(), batch)
    writer = df.write.format(format)
    (writer.partitionBy(*by) if by else writer).save(f"{path}/{version.folder}")
    if not _claim(spark, path, version):
        files, jvm = _files(spark, path)
        files.delete(jvm.Path(f"{path}/{version.folder}"), True)
        raise Conflict(path, read_version(spark, path, version.number))
    return version


def current(spark: SparkSession, path: str, number: int | None = None, format: str = "parquet") -> DataFrame:
    """The version of this number, or the last one."""
    version = latest(spark, path) if number is None else read_version(spark, path, number)
    if version is None:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.schema(StructType.fromJson(json.loads(version.schema))).format(format).load(f"{path}/{version.folder}")


def forget(spark: SparkSession, path: str, keep: int) -> None:
    """Deletes all but the last `keep` versions (one at least stays): pointers first, so no pointer names a folder that is gone."""
    files, jvm = _files(spark, path)
    for number in numbers(spark, path)[: -max(keep, 1)]:
        folder = read_version(spark, path, number).folder
        files.delete(jvm.Path(_pointer(path, number)), False)
        files.delete(jvm.Path(f"{path}/{folder}"), True)
