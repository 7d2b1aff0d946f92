"""Set operations on integers and records, short and by ranges of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.functions.numbers import block_of
from binloom.operators import scans
from binloom.operators.blocking import comparisons
from binloom.plans.params import SetParams


def by_identity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Records of the left whose identity the right has."""
    return left.join(right.select(key).distinct(), key, "left_semi")


def intersection(a: DataFrame, b: DataFrame, value: str = "v") -> DataFrame:
    return a.select(value).intersect(b.select(value))


def matches(a: DataFrame, b: DataFrame, value: str = "v") -> DataFrame:
    """Equal values once per pair of rows that hold them."""
    return a.select(value).join(b.select(value), value)


def range_blocks(a: DataFrame, p: SetParams, value: str = "v") -> DataFrame:
    return a.select(value, block_of(F.col(value), p).alias("tag"))


def range_join(a: DataFrame, b: DataFrame, p: SetParams, value: str = "v") -> DataFrame:
    """Values equal within a block; equal values always share one."""
    return range_blocks(a, p, value).join(range_blocks(b, p, value), ["tag", value]).select("tag", value)


def range_comparisons(a: DataFrame, b: DataFrame, p: SetParams, value: str = "v") -> DataFrame:
    return comparisons(range_blocks(a, p, value), range_blocks(b, p, value), "tag")


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the least `order`, by an aggregation that combines before the shuffle."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def top_n(df: DataFrame, key: str, n: int | None = None, rate: float = 1.0) -> DataFrame:
    """The first n rows by key, in order, for the few of a report; without n (or with 0) a share of all rows, rounded up, found by scans.first_rows and not sorted."""
    return df.orderBy(key).limit(n) if n else scans.first_rows(df, [key], rate=rate)


def ecdf(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """Share of values strictly under each point, all points in one pass; null without values."""
    found = df.agg(F.count(value).alias("n"), *[F.count_if(F.col(value) < x).alias(f"c{i}") for i, x in enumerate(at)])
    rows = F.array(*[F.struct(F.lit(float(x)).alias("at"), F.try_divide(F.col(f"c{i}"), F.col("n")).alias("share")) for i, x in enumerate(at)])
    return found.select(F.inline(rows))


def fill_forward(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """The value, or where it is null the nearest one before it in its group; `order` should tell all rows apart."""
    frame = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("filled", F.last(value, ignorenulls=True).over(frame))
