"""Joins on keys that may be very unequal in size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEY = 100_000


def join_by_key(rows: DataFrame, keys: DataFrame, on: list[str], count: Column, hot: int = HOT_KEY) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, which holds each key once with the ``count`` of its rows.

    Keys of more than ``hot`` rows, of which there are at most rows / ``hot``, go to every task, so
    their rows stay where they are; the rest is shuffled. Both inputs are read twice: cut them first.
    """
    big = F.broadcast(keys.where(count > hot))
    rest = rows.join(F.broadcast(keys.where(count > hot).select(*on)), on, "left_anti")
    return rows.join(big, on).unionByName(rest.join(keys.where(count <= hot), on))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], hot: int = HOT_KEY, few: int = 500_000) -> DataFrame:
    """Inner join of two tables that may hold a key many times each.

    A right side of at most ``few`` rows goes to every task. Else the rows of a key with more than ``hot``
    left rows (at most rows / ``hot`` keys) are spread over several tasks, to each of which its right rows go.
    Both inputs are read more than once: cut them first.
    """
    if right.limit(few + 1).count() <= few:
        return left.join(F.broadcast(right), on)
    parts = left.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select(*on, F.ceil(F.col("__n") / hot).cast("int").alias("__parts"))
    parts = F.broadcast(parts)
    spread = left.join(parts, on, "left").withColumn("__salt", F.floor(F.rand(11) * F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    copies = right.join(parts, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return spread.join(copies, [*on, "__salt"]).drop("__salt")
