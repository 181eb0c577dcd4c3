"""UPDATE and DELETE as frames: the whole new content of a table, and what a UNIQUE index has against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.compiler import ROWID


def deleted(df: DataFrame, condition: Column | None) -> DataFrame:
    """``df`` without the rows for which ``condition`` is true; without one, no row stays."""
    return df.limit(0) if condition is None else df.filter(~F.coalesce(condition, F.lit(False)))


def updated(df: DataFrame, sets: dict[str, Column], condition: Column | None) -> DataFrame:
    """``df`` with new values where ``condition`` is true; all of them see the old row."""
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    by = {c.casefold(): v for c, v in sets.items()}
    return df.select(*(F.when(hit, by[c.casefold()]).otherwise(F.col(f"`{c}`")).alias(c) if c.casefold() in by else F.col(f"`{c}`") for c in df.columns))


def update_conflicts(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that an update, done row by row in row order, would find taken.

    A row's new key conflicts with the old key of a later row and with the new key of an earlier one.
    """
    keys = [f"k{i}" for i in range(len(columns))]
    some = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    take = lambda df, rowid: df.select(F.col(ROWID).alias(rowid), *(F.col(f"`{c}`").alias(k) for c, k in zip(columns, keys, strict=True))).filter(some)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    changed = take(new, "s").alias("a").join(take(old, "s").alias("b"), [F.col("a.s") == F.col("b.s"), *same], "left_anti")
    # a row a key on both sides: no pairs of rows, however many share a key
    moved = changed.groupBy(*keys).agg(F.min("s").alias("first"), F.max("s").alias("last"))
    held = take(old, "r").groupBy(*keys).agg(F.max("r").alias("old"))
    given = take(new, "r").groupBy(*keys).agg(F.min("r").alias("new"))
    later = moved.join(held, keys).filter(F.col("old") > F.col("first")).select(*keys)
    earlier = moved.join(given, keys).filter(F.col("new") < F.col("last")).select(*keys)
    return later.union(earlier).distinct()
