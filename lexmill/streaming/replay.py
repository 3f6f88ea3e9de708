"""Replays over recorded events: the circuit breaker of each proxy, and streams run to their end."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def circuit_breaker(events: DataFrame, failures: int = 5, cooldown: float = 300.0) -> DataFrame:
    """(proxy, at, state) for each transition of each proxy's breaker, from events (proxy, at: seconds, ok).

    So many failures in a row make a proxy dead; a success sets the count to 0; while dead nothing counts; the first event
    after the cooldown finds it revived with a count of 0.  Each proxy's events run past in order of time (failures first at
    one time) and only its count is held, so a proxy of any size needs no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proxy, count, died = None, 0, None
        for batch in batches:
            out: list[tuple] = []
            for own, at, ok in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != proxy:
                    proxy, count, died = own, 0, None
                if died is not None and at - died >= cooldown:
                    out.append((proxy, died + cooldown, "revived"))
                    count, died = 0, None
                if died is None:
                    count = 0 if ok else count + 1
                    if count >= failures:
                        died = at
                        out.append((proxy, at, "dead"))
            yield pa.RecordBatch.from_pylist([dict(zip(("proxy", "at", "state"), r, strict=True)) for r in out], pa.schema([("proxy", pa.int64()), ("at", pa.float64()), ("state", pa.string())]))

    rows = events.select(F.col("proxy").cast("bigint"), F.col("at").cast("double"), "ok").where("proxy is not null and at is not null and ok is not null")
    return rows.repartition("proxy").sortWithinPartitions("proxy", "at", "ok").mapInArrow(run, "proxy bigint, at double, state string")
