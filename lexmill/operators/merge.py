"""State merges as pure functions (state, delta) -> state, and edges and paths over edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rule: how a column of the merged row follows from the old and the new one.
RULES = {
    "new": lambda old, new: F.coalesce(new, old),
    "keep": lambda old, new: F.coalesce(old, new),
    "sum": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
    "english_wins": lambda old, new: F.when((old == "en") | (new == "en"), "en").otherwise(F.coalesce(new, old)),
}


def upsert(state: DataFrame, delta: DataFrame, keys: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """Full outer merge on the keys; each other column of state follows its rule (``keep`` if unnamed)."""
    old, new = state.alias("old"), delta.alias("new")
    joined = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full_outer")
    columns = [F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in keys]
    for c in (c for c in state.columns if c not in keys):
        fresh = F.col(f"new.{c}") if c in delta.columns else F.lit(None)
        columns.append(RULES[rules.get(c, "keep")](F.col(f"old.{c}"), fresh).alias(c))
    return joined.select(*columns)


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows of each key the first by order, all columns deciding between equal ones; nulls come first.  An aggregation: rows are
    reduced where they are read, before any are moved."""
    rest = [c for c in rows.columns if c not in keys]
    by = F.struct(*(x for c in [*order, *(c for c in rest if c not in order)] for x in (F.col(c).isNotNull(), F.col(c))))
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_first")) if rest else rows.distinct()
    return best.select(*(F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns))


def insert_or_ignore(state: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    return state.unionByName(delta.join(state.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)
