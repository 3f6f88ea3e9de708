"""All queries over the reference's own operators, by name, with their oracle SQL.

A plan is SQL over facades; the same text runs in Spark and, but for function names that differ, in the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import corpus, extraction, freshness, ledger, monitoring, payloads, rules, scans, states, upkeep
from lexmill.plans.facades import FACADES, with_facades
from lexmill.session import views


def _query(text: str, tables: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables)
        return spark.sql(text)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _plans in (ledger, monitoring, freshness, corpus):
    for _name, (_facades, _body) in _plans.PLANS.items():
        _text, _tables = with_facades(_body, *(f for f in _facades if f in FACADES))
        _more = getattr(_plans, "EXTRA_TABLES", {}).get(_name, ())
        QUERIES[_name] = _query(_text.replace("sha256(text)", "sha2(text, 256)"), tuple(dict.fromkeys((*_tables, *_more))))
        ORACLE_SQL[_name] = _text
for _module in (extraction, payloads, states, rules, scans, upkeep):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
