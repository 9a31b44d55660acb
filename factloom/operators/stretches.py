"""Neighbours and running maxima in the order of a log, without a task that holds a whole key.

A log's integer places are cut into stretches of a fixed width. Windows run over a key's stretch, and what they need of other stretches comes from a
table with one row for each stretch of each key. A key with a third of all rows is as many tasks as it has stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65_536


def _cut(rows: DataFrame, order: str, key: tuple[str, ...], width: int, own: dict[str, Column]) -> DataFrame:
    """`row` as it is, `at`, `key` (in which nulls are equal), `range`, and columns of our own."""
    return rows.select(F.struct("*").alias("row"), F.col(order).alias("at"), F.struct(*(F.col(c).alias(c) for c in key)).alias("key"), F.floor(F.col(order) / width).alias("range"), *(c.alias(n) for n, c in own.items()))


def neighbours(rows: DataFrame, what: Column, order: str, *key: str, width: int = WIDTH) -> DataFrame:
    """Adds `_was` and `_next`: `what` (never null) of the row before and after in its key; NULL at the ends."""
    w, over = Window.partitionBy("key", "range").orderBy("at"), Window.partitionBy("key").orderBy("range")
    d = _cut(rows, order, key, width, {"own": what})
    ends = d.groupBy("key", "range").agg(F.min_by("own", "at").alias("first"), F.max_by("own", "at").alias("final"))
    ends = ends.select("key", "range", F.lag("final").over(over).alias("before"), F.lead("first").over(over).alias("after"))
    d = d.withColumns({"was": F.lag("own").over(w), "next": F.lead("own").over(w)}).join(ends, ["key", "range"])
    return d.select("row.*", F.coalesce("was", "before").alias("_was"), F.coalesce("next", "after").alias("_next"))


def running_max(rows: DataFrame, columns: dict[str, Column], order: str, *key: str, width: int = WIDTH) -> DataFrame:
    """Adds for each name the largest value of its column in the rows before of the same key; NULL where there is none."""
    w, over = Window.partitionBy("key", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    names = list(columns)
    d = _cut(rows, order, key, width, {f"own{i}": columns[n] for i, n in enumerate(names)})
    tops = d.groupBy("key", "range").agg(*(F.max(f"own{i}").alias(f"top{i}") for i in range(len(names))))
    tops = tops.select("key", "range", *(F.max(f"top{i}").over(over).alias(f"top{i}") for i in range(len(names))))
    d = d.withColumns({f"in{i}": F.max(f"own{i}").over(w) for i in range(len(names))}).join(tops, ["key", "range"])
    larger = lambda i: F.when(F.col(f"in{i}").isNull() | (F.col(f"top{i}") > F.col(f"in{i}")), F.col(f"top{i}")).otherwise(F.col(f"in{i}"))
    return d.select("row.*", *(larger(i).alias(n) for i, n in enumerate(names)))
