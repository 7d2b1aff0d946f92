"""Scans over a whole table in one order, without ever putting the table into one task.

The order's keys are cut into ranges at sampled bounds. A row's range follows from its key alone, so every pass over the
data, and every task that is run again, deals the rows alike; the sample decides how even the ranges are, never the result.
One aggregation gives what each range adds up to, a row per range; the driver carries that from range to range; and a
window within each range, with what is carried into it, gives the rows their values. That is three light passes (count,
sample, sums) and one exchange of the rows, which spills like any sort.

Scans by group (`by`) start anew with each group. A group may span ranges and a range may hold groups: only the last group
of a range goes on into the next. `by` columns are of any type that equals itself (NaN does not).
Rows that tie under the order take any order among themselves, so an order should tell rows apart where that matters.
Nulls come first. Columns named __scan_... are the scans' own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range should have, ranges at most, and sampled keys per range. The driver holds MOST_RANGES * SAMPLES keys.
RANGE_ROWS, MOST_RANGES, SAMPLES = 1_000_000, 4096, 20
#: So many keys are looked at one by one when a rank is searched.
FEW_KEYS = 10_000


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


class Ranges:
    """Bounds that cut the keys of a table into ranges of about equal size, the keys of a range next to each other."""

    def __init__(self, df: DataFrame, order: Sequence[str | Column], rows: int | None = None, least: int | None = None) -> None:
        self.spark, self.order = df.sparkSession, _columns(order)
        self.rows = df.count() if rows is None else rows
        wanted = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")) if least is None else least, math.ceil(self.rows / RANGE_ROWS))
        wanted = min(wanted, MOST_RANGES)
        keys = df.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(self.order)]).alias("key"))
        share = min(1.0, 1.5 * SAMPLES * wanted / max(self.rows, 1))
        sample = (keys if share == 1.0 and self.rows <= SAMPLES * wanted else keys.sample(share, 7)).orderBy("key").collect()
        step = max(1, len(sample) // wanted)
        bounds = []
        for r in sample[step::step]:
            if not bounds or bounds[-1] != r.key:
                bounds.append(r.key)
        self.bounds = bounds[: MOST_RANGES - 1]
        self.type = keys.schema["key"].dataType

    def key(self) -> Column:
        return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(self.order)])

    def marked(self, df: DataFrame, name: str = "__scan_range") -> DataFrame:
        """df with the number of each row's range: how many bounds are no more than its key, by binary search."""
        if not self.bounds:
            return df.withColumn(name, F.lit(0))
        row = self.spark.createDataFrame([(self.bounds,)], f"__scan_bounds array<{self.type.simpleString()}>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(self.bounds).bit_length()))])
        at = F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.get("__scan_bounds", found + step - 1) <= F.col("__scan_key"), found + step).otherwise(found))
        keyed = df.withColumn("__scan_key", self.key()).crossJoin(F.broadcast(row))
        return keyed.withColumn(name, at).drop("__scan_bounds", "__scan_key")


def _carried(df: DataFrame, order: Sequence[str | Column], by: Sequence[str], part: Column, add: Callable, least: int | None = None) -> DataFrame:
    """df with __scan_range and __scan_carry: what `add` makes of `part` over all earlier ranges of the row's group, null where nothing was before."""
    cut = Ranges(df, [*by, *order], least=least)
    group = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)]) if by else F.struct(F.lit(0).alias("g0"))
    marked = cut.marked(df).withColumn("__scan_by", group)
    own = marked.groupBy("__scan_range", "__scan_by").agg(part.alias("part"))
    ends = own.groupBy("__scan_range").agg(F.min("__scan_by").alias("first"), F.max_by(F.struct("__scan_by", "part"), "__scan_by").alias("last"))
    carries, group_so_far, so_far = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r["__scan_range"]):
        if so_far is not None and r.first == group_so_far:
            carries.append((r["__scan_range"], r.first, so_far))
        last_group, last = r.last
        so_far = add(so_far, last) if last_group == group_so_far else last
        group_so_far = last_group
    kind = own.schema
    rows = df.sparkSession.createDataFrame(carries, f"__scan_at int, __scan_of {kind['__scan_by'].dataType.simpleString()}, __scan_carry {kind['part'].dataType.simpleString()}")
    # a row per range at most
    return marked.join(F.broadcast(rows), (F.col("__scan_range") == F.col("__scan_at")) & F.col("__scan_by").eqNullSafe(F.col("__scan_of")), "left").drop("__scan_at", "__scan_of")


def _done(df: DataFrame) -> DataFrame:
    return df.drop("__scan_range", "__scan_by", "__scan_carry")


def _so_far(order: Sequence[str | Column]) -> Window:
    return Window.partitionBy("__scan_range", "__scan_by").orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(df: DataFrame, order: Sequence[str | Column], value: Column, by: Sequence[str] = (), upto: str = "upto", before: str | None = None, least: int | None = None) -> DataFrame:
    """Adds `upto`, the sum of value over the rows so far, and on request `before`, the same without the row's own. Null counts as nothing."""
    held = df.withColumn("__scan_value", F.coalesce(value, F.lit(0)))
    carried = _carried(held, order, by, F.sum("__scan_value"), lambda a, b: a + b, least)
    out = carried.withColumn(upto, F.sum("__scan_value").over(_so_far(order)) + F.coalesce("__scan_carry", F.lit(0)))
    return _done(out.withColumn(before, F.col(upto) - F.col("__scan_value")) if before else out).drop("__scan_value")


def numbered(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Adds each row's place in the order, from 1."""
    return running(df, order, F.lit(1).cast("long"), by, name)


def filled(df: DataFrame, order: Sequence[str | Column], value: Column, by: Sequence[str] = (), name: str = "filled", least: int | None = None) -> DataFrame:
    """Adds the row's value, or where that is null the nearest one before it; null if there is none."""
    held = df.withColumn("__scan_value", value)
    last = F.max_by("__scan_value", F.when(F.col("__scan_value").isNotNull(), F.struct(*_columns(order))))
    carried = _carried(held, order, by, last, lambda a, b: a if b is None else b, least)
    out = carried.withColumn(name, F.coalesce(F.last("__scan_value", ignorenulls=True).over(_so_far(order)), F.col("__scan_carry")))
    return _done(out).drop("__scan_value")


def shares_under(values: DataFrame, value: Column, points: DataFrame, point: Column) -> DataFrame:
    """(at, under, share): for each different point how many values are strictly under it, and their share of all; null without values.

    Values and points become one table, a row per different number with how often it is a value, so repeated ones weigh nothing.
    Null values and points take no part.
    """
    both = values.select(value.alias("at"), F.lit(1).alias("n"), F.lit(False).alias("asked")).unionAll(points.select(point.alias("at"), F.lit(0), F.lit(True)))
    each = both.where(F.col("at").isNotNull()).groupBy("at").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    total = F.broadcast(values.agg(F.count(value).alias("__scan_total")))
    placed = running(each, ["at"], F.col("n"), upto="upto", before="under").where("asked")
    return placed.crossJoin(total).select("at", "under", F.try_divide("under", "__scan_total").alias("share"))


def key_at(df: DataFrame, order: Sequence[str | Column], rank: int, rows: int | None = None):
    """The key (a row of k0, k1, ...) of the row with this rank from 1, null if there are fewer rows.

    Counts per range tell which range holds it; that range is cut again, until few keys are left. Each step looks at a part
    of the part before, about a MOST_RANGES-th of it. Rows of one key, however many, are told from the rest by one count.
    """
    rows = df.count() if rows is None else rows
    if not 1 <= rank <= rows:
        return None
    part = df.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_columns(order))]).alias("key"))
    names = [f"key.k{i}" for i in range(len(order))]
    while rows > FEW_KEYS:
        cut = Ranges(part, names, rows, least=MOST_RANGES // 8)
        counts = {r["__scan_range"]: r["count"] for r in cut.marked(part).groupBy("__scan_range").count().collect()}
        at, before = 0, 0
        while before + counts.get(at, 0) < rank:
            before, at = before + counts.get(at, 0), at + 1
        rank, rows = rank - before, counts[at]
        if at < len(cut.bounds):
            part = part.where(F.col("key") < _literal(part, cut.bounds[at]))
        if at:
            low = _literal(part, cut.bounds[at - 1])
            same = part.where(F.col("key") == low).count()
            if rank <= same:
                return cut.bounds[at - 1]
            part, rank, rows = part.where(F.col("key") > low), rank - same, rows - same
    return part.orderBy("key").limit(rank).collect()[-1].key


def _literal(df: DataFrame, key, name: str = "key") -> Column:
    fields = df.schema[name].dataType.fields
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, fields, strict=True)])


def first_rows(df: DataFrame, order: Sequence[str], n: int | None = None, rate: float = 1.0) -> DataFrame:
    """Exactly the first n rows, or without n the first share of all rows, rounded up; not sorted.

    The bound is found by key_at, then a filter takes the rows. Rows that tie under the order are told apart by a hash of all
    their columns; of rows that equal each other throughout, as many as are wanted are written out from one of them.
    """
    rows = df.count()
    wanted = min(rows, n if n is not None else math.ceil(rows * rate))
    if wanted <= 0:
        return df.where(F.lit(False))
    keys = [*_columns(order), F.xxhash64(*[F.col(c) for c in df.columns])]
    key = "__scan_key"
    held = df.select("*", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(keys)]).alias(key))
    bound = key_at(df, keys, wanted, rows)
    if isinstance(order[0], str) and bound[0] is not None:
        # says of the first column alone what the scan can skip
        held = held.where(F.col(order[0]).isNull() | (F.col(order[0]) <= F.lit(bound[0]).cast(df.schema[order[0]].dataType)))
    last = _literal(held, bound, key)
    under, same = held.where(F.col(key) < last).drop(key), held.where(F.col(key) == last).drop(key)
    counts = held.agg(F.count_if(F.col(key) < last).alias("under"), F.count_if(F.col(key) == last).alias("same")).first()
    left = wanted - counts.under
    if left == counts.same:
        return held.where(F.col(key) <= last).drop(key)
    again = df.sparkSession.range(left).select(F.col("id").alias("__scan_copy"))
    return under.unionAll(again.crossJoin(F.broadcast(same.limit(1))).drop("__scan_copy"))


def seeded_hash(key: Column, seed: int) -> Column:
    """60 bits of the MD5 of seed and key, which every SQL engine can say."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def dealt(df: DataFrame, block: str, key: str, size: int, seed: int = 1, name: str = "chunk") -> DataFrame:
    """Adds the chunk of `size` rows that a seeded shuffle deals a row to, by block. Keys tell the rows of a block apart.

    The shuffle is an order by hash, so chunks are places in it, and a block of any size is numbered by ranges of hashes.
    """
    shuffled = numbered(df.withColumn("__scan_hash", seeded_hash(F.col(key), seed)), ["__scan_hash", key], [block], "__scan_place")
    return shuffled.withColumn(name, F.floor((F.col("__scan_place") - 1) / size)).drop("__scan_hash", "__scan_place")
