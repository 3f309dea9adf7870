"""Ordered operators: first-seen dedup, islands, runs, fills, votes with first-seen ties, as-of lookups.

Order always comes from explicit columns (ordinal, row, col); nothing depends on the order of rows in files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.params import BAND_GAP


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def merge_spans(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Adjacent or overlapping spans joined: keys, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) > before + 1, 1).otherwise(0)).over(w)
    return df.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__i")


def gap_bands(df: DataFrame, keys: list[str], value: str, gap: int = BAND_GAP) -> DataFrame:
    """Adds band (from 1): a step of gap or more opens a new one."""
    w = Window.partitionBy(*keys).orderBy(value)
    step = F.col(value) - F.lag(value).over(w)
    return df.withColumn("band", (F.sum(F.when(step >= gap, 1).otherwise(0)).over(w) + 1).cast("long"))


def integer_runs(df: DataFrame, keys: list[str], place: str, value: str, least: int) -> DataFrame:
    """Runs of values that grow by one from place to place: keys, first place, last place, first value, n."""
    w = Window.partitionBy(*keys).orderBy(place)
    apart = F.col(value) - F.row_number().over(w)
    out = df.withColumn("__d", apart)
    changed = F.when(F.col("__d") == F.lag("__d").over(w), 0).otherwise(1)
    out = out.withColumn("__i", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.groupBy(*keys, "__i").agg(F.min(place).alias("first_place"), F.max(place).alias("last_place"), F.min(value).alias("first_value"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("__i")


def equal_runs(df: DataFrame, keys: list[str], place: str, value: str, least: int = 3) -> DataFrame:
    """The longest run of equal values at consecutive places of each key (the first of equals): keys, value, first_place, n."""
    by_value = Window.partitionBy(*keys, value).orderBy(place)
    runs = df.withColumn("__i", F.col(place) - F.row_number().over(by_value)).groupBy(*keys, value, "__i").agg(F.min(place).alias("first_place"), F.count("*").alias("n"))
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_place")
    return runs.where(F.col("n") >= least).withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn", "__i")


def fill_forward(value: str, keys: list[str], order: list[str]) -> Column:
    """The last value that is not null at or before a row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most common value of each key, first seen among equals: keys, value, n, total, exceptions."""
    votes = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    w = Window.partitionBy(*keys)
    best = w.orderBy(F.desc("n"), "__first")
    votes = votes.withColumns({"__rn": F.row_number().over(best), "total": F.sum("n").over(w), "exceptions": F.count("*").over(w) - 1})
    return votes.where("__rn = 1").drop("__rn", "__first")


def numeric_summary(df: DataFrame, keys: list[str], order: str, number: str, text: str) -> DataFrame:
    """first, last (as text), min, max, constant and n of the numbers of each key."""
    rows = df.where(F.col(number).isNotNull())
    return rows.groupBy(*keys).agg(F.min_by(text, order).alias("first"), F.max_by(text, order).alias("last"), F.min(number).alias("min"), F.max(number).alias("max"), (F.min(number) == F.max(number)).alias("constant"), F.count("*").alias("n"))


def noise_floor(number: str, keys: list[str], ratio: float) -> Column:
    """0 where a number is under ratio times the largest of its series."""
    top = F.max(F.abs(number)).over(Window.partitionBy(*keys))
    return F.when(F.abs(number) < top * ratio, F.lit(0.0)).otherwise(F.col(number))


def disambiguate(key: str, marker: str, scope: list[str]) -> Column:
    """key@marker where a key is repeated with different markers in its scope."""
    w = Window.partitionBy(*scope, key)
    kinds = F.size(F.collect_set(marker).over(w))
    return F.when((F.count("*").over(w) > 1) & (kinds > 1) & F.col(marker).isNotNull(), F.concat(F.col(key), F.lit("@"), F.col(marker))).otherwise(F.col(key))


def capped_ids(df: DataFrame, keys: list[str], ident: str, order: str, cap: int) -> DataFrame:
    """Distinct ids in first-seen order, at most cap of them, with the whole count: keys, n, ids."""
    seen = df.groupBy(*keys, ident).agg(F.min(order).alias("__o"))
    w = Window.partitionBy(*keys).orderBy("__o", ident)
    seen = seen.withColumn("__rn", F.row_number().over(w))
    kept = F.array_sort(F.collect_list(F.when(F.col("__rn") <= cap, F.struct("__rn", ident))))
    return seen.groupBy(*keys).agg(F.count("*").alias("n"), F.transform(kept, lambda x: x.getField(ident)).alias("ids"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with the value of the latest right row at or before it (right has keys, at, value), by one union and window."""
    both = left.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__left": F.lit(1)}).unionByName(right.select(*keys, at, F.col(value).alias("__v"), F.lit(0).alias("__left")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "__left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__left = 1").drop("__v", "__left")
