"""File inventories and event logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How stamps are written.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
EVENT = "ts timestamp, kind string, court string, year int, num int, proxy_url string, url string, http_status int, elapsed_ms double, error_class string, error_msg string, response_len int, retry_attempt int"


def inventory(spark: SparkSession, root: str, pattern: str = r"/hk[a-z]+/[0-9]{4}/") -> DataFrame:
    """path, length, mtime and name of the files below root whose path has the pattern; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.col("modificationTime").alias("mtime"), F.element_at(F.split("path", "/"), -1).alias("name")).where(F.col("path").rlike(pattern))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines log; lines that are no JSON objects go."""
    parsed = spark.read.text(path).select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    return parsed.select("e.*").where("kind IS NOT NULL")


def append_events(events: DataFrame, path: str) -> None:
    """One JSON object a line, without null fields, stamps to the microsecond."""
    events.select(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "true", "timestampFormat": STAMP}).alias("value")).write.mode("append").text(path)
