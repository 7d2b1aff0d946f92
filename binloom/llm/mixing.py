"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source has a weight; its target is its share of all words, at most `cap` times the words that
it has, the excess going to the others by weight. The mix should differ as little as it can from the
documents as they are: of all document rates that meet the targets, take those with the least
Kullback-Leibler divergence from 1, words counted. The Lagrangian dual of that problem is convex, and
its solution tilts each document by exp(multiplier of its source). Newton steps solve the dual; as
each constraint has its own multiplier, they need each source's words only, which one aggregation with
partial sums gives, and no further pass over documents.

A rate's whole part becomes copies. Its fraction is settled in each size band (binary order of magnitude)
of each source: documents get one more copy in the order of a hash, up to the one at which the fraction
of the band's words is reached. That document is found without sorting: words are summed by the leading bits
of the hash, then by the next bits within the one range that holds it, until a single hash is left. From the
largest sizes to the smallest, it gets the copy or not, and what is missing or too much is carried on. So
the words taken differ from the target by about one document, however large the source, and no group
grows with the input: a pass has 2 ** LEVEL_BITS ranges a band at most.

Constraints that overlap (a source, a language and a size band, say) couple the multipliers; `plan_constrained` solves the
same dual for them by Newton steps of one aggregation each, and rounds by patterns of constraints as by sources.

Defined results: tables without rows give none; null and empty texts have size 0 and are taken 0 times or as their rate says, which
takes no words; null sources are a source of their own, the last; sources without words have the
target 0; repeated rows share a hash and are treated alike; results depend on ids and sizes alone, so
reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.llm.shared import dropped, stored

BANDS = 24
HASH_BITS, LEVEL_BITS = 63, 12
NEWTON_STEPS = 60
#: Sources with rows of no more than this in all go to each executor whole; more are joined by shuffle.
BROADCAST_SOURCES = 2_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], source: str, size: str, cap: float) -> DataFrame:
    """One row per source: __source, words, target.

    Sources stop at the cap in the order of cap * words / weight, so a running sum over that order finds the level.
    """
    by = sizes.groupBy(F.col(source).alias("__source")).agg(F.sum(size).alias("words"))
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    ring = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("w", F.get(ring, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    by = by.withColumn("most", F.lit(float(cap)) * F.col("words"))
    level = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("__source").asc_nulls_last())
    before, every = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    full = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    by = by.withColumn("mu", (F.sum("words").over(every) - full) / left)
    # taking out a source above its cap raises mu, taking out one below it lowers mu: the level is the largest
    return by.select("__source", "words", F.least("most", F.max("mu").over(every) * F.col("w")).alias("target"))


def balanced_rates(targets: DataFrame, cap: float) -> DataFrame:
    """Adds multiplier and rate: Newton on the dual, whose gradient is words * exp(m) - target and whose second derivative is words * exp(m).

    A step is held to 1 so that no exponential overflows; without words or target the rate is 0.
    """

    def step(m: Column, _: Column) -> Column:
        mass = F.col("words") * F.exp(m)
        return m - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (mass - F.col("target")) / mass))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)
    out = targets.withColumn("multiplier", F.when((F.col("words") > 0) & (F.col("target") > 0), solved))
    return out.withColumn("rate", F.coalesce(F.least(F.lit(float(cap)), F.round(F.exp("multiplier"), 12)), F.lit(0.0)))


def constrained_rates(cells: DataFrame, targets: list[float], cap: float) -> DataFrame:
    """Rates of cells (__source, n), documents that meet the same constraints: __source has a 1 at each constraint met, else a 0.

    Constraints may overlap, so the dual has an equation per constraint in all multipliers. It is sum(n * f(s)) - sum(target * m)
    with s the sum of a cell's multipliers, f(s) = exp(s) up to the cap and straight on from there; its gradient is what the
    mix takes too much of each constraint, its second derivatives the words that two constraints share, below the cap. Each
    Newton step is one aggregation; a step is halved until the dual falls. Targets that no rates up to the cap can meet are an error.
    """
    spark = cells.sparkSession
    cells = stored(spark, cells.groupBy("__source").agg(F.sum("n").alias("words")).where("words > 0"), "mix-cells")
    count = len(targets)
    met = [F.substring("__source", j + 1, 1) == "1" for j in range(count)]

    def tilt(m: list[float]) -> Column:
        return sum((F.when(met[j], F.lit(m[j])).otherwise(F.lit(0.0)) for j in range(count)), F.lit(0.0))

    def sums(m: list[float]) -> tuple[float, list[float], list[list[float]]]:
        s, top = tilt(m), math.log(cap)
        rate = F.exp(F.least(s, F.lit(top)))
        value = rate + cap * F.greatest(s - top, F.lit(0.0))
        bend = F.when(s < top, F.col("words") * rate).otherwise(F.lit(0.0))
        firsts = [F.sum(F.when(x, F.col("words") * rate).otherwise(F.lit(0.0))) for x in met]
        seconds = [F.sum(F.when(met[j] & met[k], bend).otherwise(F.lit(0.0))) for j in range(count) for k in range(j + 1)]
        row = cells.agg(*[c.alias(f"c{i}") for i, c in enumerate([F.sum(F.col("words") * value), *firsts, *seconds])]).first()
        total, flat = row[0] or 0.0, [x or 0.0 for x in row[1 + count :]]
        gradient = [(row[1 + j] or 0.0) - targets[j] for j in range(count)]
        bends = [[flat[max(j, k) * (max(j, k) + 1) // 2 + min(j, k)] for k in range(count)] for j in range(count)]
        return total - sum(t * x for t, x in zip(targets, m, strict=True)), gradient, bends

    m = [0.0] * count
    value, gradient, bends = sums(m)
    enough = 1e-9 * max(1.0, *targets)
    for _ in range(NEWTON_STEPS):
        if max(map(abs, gradient), default=0.0) <= enough:
            break
        step, far = _solved(bends, gradient), 1.0
        far = min(1.0, 4.0 / max(1e-9, *map(abs, step)))
        while far > 1e-6:
            tried = [x - far * d for x, d in zip(m, step, strict=True)]
            found = sums(tried)
            if found[0] <= value - 1e-4 * far * sum(g * d for g, d in zip(gradient, step, strict=True)) or max(map(abs, found[1])) < 0.5 * max(map(abs, gradient)):
                break
            far /= 2
        m, (value, gradient, bends) = tried, found
    if max(map(abs, gradient), default=0.0) > 1e-3 * max(1.0, *targets):
        raise ValueError("no rates up to the cap meet these targets")
    rate = F.round(F.exp(F.least(tilt(m), F.lit(math.log(cap)))), 12)
    return cells.select("__source", "words", (rate * F.col("words")).alias("target"), rate.alias("rate"))


def _solved(rows: list[list[float]], right: list[float]) -> list[float]:
    """x of rows x = right, for a few rows; a little is added to the diagonal, so that constraints that repeat each other do no harm."""
    n, most = len(right), max(1e-300, *(abs(rows[k][k]) for k in range(len(right))))
    a = [[x + (1e-12 * most if i == k else 0.0) for k, x in enumerate(row)] + [b] for i, (row, b) in enumerate(zip(rows, right, strict=True))]
    for k in range(n):
        p = max(range(k, n), key=lambda i: abs(a[i][k]))
        a[k], a[p] = a[p], a[k]
        for i in range(n):
            if i != k:
                f = a[i][k] / a[k][k]
                a[i] = [x - f * y for x, y in zip(a[i], a[k], strict=True)]
    return [a[k][n] / a[k][k] for k in range(n)]


def plan_constrained(docs: DataFrame, constraints: list[tuple[Column, float]], cap: float = 3.0, id_col: str = "doc_id", size: str = "size") -> DataFrame:
    """docs with __rate and __copies such that each constraint's documents have about its target of words together.

    A constraint is a condition on documents and a number of words: a source, a language, a size band, the whole. Documents
    may meet several or none; those that meet none have the rate 1. A null condition is not met. Columns of docs named __rate and
    __copies are replaced. The pattern of constraints
    takes the place of the source in what follows.
    """
    pattern = F.concat(*[F.when(F.coalesce(c, F.lit(False)), "1").otherwise("0") for c, _ in constraints])
    packed = docs.select(F.struct("*").alias("__row"), docs[id_col].alias("__id"), docs[size].cast("long").alias("__size"), pattern.alias("__pattern"))
    planned = _planned(packed, lambda sizes: constrained_rates(sizes, [t for _, t in constraints], cap), cap, "__id", "__pattern", "__size")
    return planned.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c not in ("__rate", "__copies")], "__rate", "__copies")


def _band(size: Column) -> Column:
    return F.least(F.lit(BANDS - 1), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int"))


def _hash(id_col: Column, size: Column) -> Column:
    return F.xxhash64(id_col, size).bitwiseAND(F.lit(2**HASH_BITS - 1))


def _last_taken(sizes: DataFrame, rates: DataFrame) -> DataFrame:
    """Of (__source, band, h, n) rows, per source and band: the hash at which the fraction is reached, its words, and the words still owed before it."""
    spark = sizes.sparkSession
    part = F.col("rate") - F.floor("rate")
    sums = sizes.groupBy(F.col("__source").alias("s"), F.col("band").alias("b")).agg(F.sum("n").alias("n"))
    state = sums.join(rates, sums["s"].eqNullSafe(rates["__source"])).where((part > 1e-9) & (F.col("n") > 0))
    state = stored(spark, state.select("s", "b", (part * F.col("n")).alias("owed"), "n", F.lit(0).cast("long").alias("h"), F.lit(False).alias("single")), "mix-state")
    place = Window.partitionBy("s", "b").orderBy("range")
    for left in [*range(HASH_BITS - LEVEL_BITS, 0, -LEVEL_BITS), 0]:
        if not state.where("not single").limit(1).count():
            break
        above = left + LEVEL_BITS
        near = sizes["__source"].eqNullSafe(state["s"]) & (sizes["band"] == state["b"]) & ~state["single"]
        if above < HASH_BITS:
            near = near & (F.shiftright(sizes["h"], above) == F.shiftright(state["h"], above))
        small = F.broadcast(state) if state.limit(BANDS * BROADCAST_SOURCES + 1).count() <= BANDS * BROADCAST_SOURCES else state
        found = sizes.join(small, near).groupBy("s", "b", F.shiftright(sizes["h"], left).alias("range"))
        found = found.agg(F.sum(sizes["n"]).alias("n"), F.min(sizes["h"]).alias("h"), F.max(sizes["h"]).alias("last"), F.first("owed").alias("owed"))
        found = found.withColumn("upto", F.sum("n").over(place)).withColumn("total", F.sum("n").over(Window.partitionBy("s", "b")))
        # sums of floats may leave as much owed as there is: then it is the last range
        found = found.where((F.col("upto") - F.col("n") <= F.col("owed")) & ((F.col("owed") < F.col("upto")) | (F.col("upto") == F.col("total"))) & (F.col("n") > 0))
        found = found.select("s", "b", (F.col("owed") - F.col("upto") + F.col("n")).alias("owed"), "n", "h", (F.col("h") == F.col("last")).alias("single"))
        older, state = state, stored(spark, state.where("single").unionByName(found), "mix-state")
        dropped(older)
    return state


def _rounding(sizes: DataFrame, rates: DataFrame) -> DataFrame:
    """Per source: words, target, rate and the largest hash of each band that gets one more copy."""
    bands = F.sort_array(F.collect_list(F.struct((-F.col("b")).alias("order"), "b", "owed", "n", "h")))
    lists = _last_taken(sizes, rates).groupBy("s").agg(bands.alias("bands"))
    table = rates.join(lists, rates["__source"].eqNullSafe(lists["s"]), "left")
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<b:int,h:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        owed = acc["owed"] + x["owed"]
        more = owed * 2 >= x["n"]
        bound = F.struct(x["b"].alias("b"), (x["h"] - F.when(more, 0).otherwise(1)).alias("h"))
        return F.struct((owed - F.when(more, x["n"]).otherwise(F.lit(0))).alias("owed"), F.concat(acc["out"], F.array(bound)).alias("out"))

    bounds = F.map_from_entries(F.aggregate("bands", start, step, lambda acc: acc["out"]))
    return table.select("__source", F.col("words").alias("__words"), F.col("target").alias("__target"), F.col("rate").alias("__rate"), bounds.alias("__bounds"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, id_col: str = "doc_id", source: str = "source", size: str = "size") -> DataFrame:
    """docs, which need a column of sizes, with __words and __target of their source, __rate, and __copies, at most cap rounded down. Columns of docs with these four names are replaced."""
    packed = docs.select(F.struct("*").alias("__row"), docs[id_col].alias("__id"), docs[source].alias("__src"), docs[size].alias("__size"))
    planned = _planned(packed, lambda sizes: balanced_rates(source_targets(sizes, weights, "__source", "n", cap), cap), cap, "__id", "__src", "__size")
    added = ["__words", "__target", "__rate", "__copies"]
    return planned.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c not in added], *added)


def _planned(docs: DataFrame, solve: Callable[[DataFrame], DataFrame], cap: float, id_col: str, source: str, size: str) -> DataFrame:
    spark, band, place = docs.sparkSession, _band(F.col(size)), _hash(F.col(id_col), F.col(size))
    sizes = stored(spark, docs.select(F.col(source).alias("__source"), band.alias("band"), place.alias("h"), F.col(size).cast("long").alias("n")), "mix-sizes")
    rates = stored(spark, solve(sizes), "mix-rates")
    table = stored(spark, _rounding(sizes, rates), "mix-table")
    dropped(sizes, rates)
    extra = (place <= F.element_at("__bounds", band)).cast("int")
    copies = F.least(F.lit(int(cap)), F.floor("__rate").cast("int") + F.coalesce(extra, F.lit(0)))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    out = docs.join(table, docs[source].eqNullSafe(table["__source"]), "left").drop(table["__source"])
    return out.withColumn("__copies", copies).drop("__bounds")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, id_col: str = "doc_id", source: str = "source", text_size: Column | None = None, copy_col: str | None = None) -> DataFrame:
    """The mixed documents with all their columns: each as many times as it has copies. copy_col, if given, numbers a document's copies from 1, in place of a column of that name."""
    packed = docs.select(F.struct("*").alias("__row"), docs[id_col].alias("__id"), docs[source].cast("string").alias("__src"), text_size.alias("__size"))
    planned = plan_mix(packed, weights, cap, "__id", "__src", "__size").where("__copies > 0")
    repeated = planned.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    kept = [F.col("__row")[c].alias(c) for c in docs.columns if c != copy_col]
    return repeated.select(*kept, *([F.col("__copy").alias(copy_col)] if copy_col else []))
