"""Set intersection in stages, each a table: chunk, pad, group dimensions, replicate, align, compare.

Both sides' values fall into blocks by range, blocks into chunks of one size, padded with values that
match nothing. A chunk of one side is repeated for every chunk of the other in its block, so that rows
paired by position run over all pairs of chunks. Positions are counted within blocks, so no stage puts
the values into one partition. Only what has a row per chunk, at most a few per block, is ordered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.functions.numbers import block_of
from binloom.operators import scans
from binloom.plans.params import SetParams


def chunk_size(a: DataFrame, b: DataFrame, p: SetParams) -> DataFrame:
    """One row: the larger side's count shared over the blocks, 1 at least."""
    counts = a.agg(F.count("*").alias("n")).unionAll(b.agg(F.count("*").alias("n")))
    return counts.agg(F.greatest(F.lit(1), F.floor(F.max("n") / p.blocks)).cast("long").alias("chunk_size"))


def chunks(a: DataFrame, b: DataFrame, p: SetParams) -> DataFrame:
    """tid (1, 2), tag, section, chunk_size, data (sorted). Blocks without values have one empty chunk."""
    spark = a.sparkSession
    both = a.select(F.lit(1).alias("tid"), "v").unionAll(b.select(F.lit(2).alias("tid"), "v")).withColumn("tag", block_of(F.col("v"), p))
    both = both.crossJoin(F.broadcast(chunk_size(a, b, p)))
    rank = F.row_number().over(Window.partitionBy("tid", "tag").orderBy("v")) - 1
    full = both.withColumn("section", F.floor(rank / F.col("chunk_size")).cast("long"))
    full = full.groupBy("tid", "tag", "section").agg(F.sort_array(F.collect_list("v")).alias("data"))
    grid = spark.range(2 * p.blocks).select((F.floor(F.col("id") / p.blocks) + 1).cast("int").alias("tid"), (F.col("id") % p.blocks).alias("tag"))
    out = grid.join(full, ["tid", "tag"], "left").select("tid", "tag", F.coalesce("section", F.lit(0).cast("long")).alias("section"), F.coalesce("data", F.array().cast("array<bigint>")).alias("data"))
    return out.crossJoin(F.broadcast(chunk_size(a, b, p)))


def padded(chunked: DataFrame, p: SetParams) -> DataFrame:
    """Chunks with their number in the table's order, data padded by mask + tid; free slots are dummies of the block after the last."""
    spark = chunked.sparkSession
    # numbers follow from how many chunks the blocks have, so no values are ordered; a side has one row per block here
    before = Window.partitionBy("tid").orderBy("tag").rowsBetween(Window.unboundedPreceding, -1)
    first = chunked.groupBy("tid", "tag").agg(F.count("*").alias("n")).select("tid", "tag", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    real = chunked.join(first, ["tid", "tag"]).withColumn("bin_number", F.col("first") + F.col("section")).drop("first")
    slots = spark.range(2 * p.slots).select((F.floor(F.col("id") / p.slots) + 1).cast("int").alias("tid"), (F.col("id") % p.slots).alias("bin_number"))
    size = F.broadcast(chunked.agg(F.max("chunk_size").alias("__size")))
    out = slots.join(real, ["tid", "bin_number"], "full").crossJoin(size)
    data = F.coalesce("data", F.array().cast("array<bigint>"))
    noise = F.array_repeat(F.lit(p.mask) + F.col("tid").cast("long"), F.greatest(F.lit(0), F.col("__size").cast("int") - F.size(data)))
    return out.select("tid", F.coalesce("tag", F.lit(p.blocks).cast("long")).alias("tag"), "bin_number", F.concat(data, noise).alias("data"))


def running_dims(table: DataFrame) -> DataFrame:
    """Chunks of each side so far in the block's order (side, number)."""
    so_far = Window.partitionBy("tag").orderBy("tid", "bin_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table.withColumns({"a1": F.count_if(F.col("tid") == 1).over(so_far), "a2": F.count_if(F.col("tid") == 2).over(so_far)})


def group_dims(table: DataFrame) -> DataFrame:
    """Chunks of each side in the block, on every row."""
    whole = Window.partitionBy("tag")
    return table.withColumns({"a1": F.count_if(F.col("tid") == 1).over(whole), "a2": F.count_if(F.col("tid") == 2).over(whole)})


def expanded(dims: DataFrame) -> DataFrame:
    """Each chunk once per chunk of the other side in its block, numbered by copy from 0; none if there is none."""
    by = F.when(F.col("tid") == 1, F.col("a2")).otherwise(F.col("a1"))
    return dims.where(by > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), by - 1)))


def offsets(dims: DataFrame) -> DataFrame:
    """Per chunk its copies, their running sum and the first position, by side: a scan by ranges of chunks."""
    by = F.when(F.col("tid") == 1, F.col("a2")).otherwise(F.col("a1"))
    out = scans.running(dims.select("tid", "tag", "bin_number", by.alias("copies")), ["tag", "bin_number"], F.col("copies"), ["tid"], "upto")
    return out.withColumn("first", F.col("upto") - F.col("copies") + 1).select("tid", "tag", "bin_number", "copies", "upto", "first")


def copy_ordinals(rows: DataFrame) -> DataFrame:
    """0-based place of a row among those of its chunk."""
    return rows.withColumn("p", (F.row_number().over(Window.partitionBy("tid", "bin_number").orderBy("copy")) - 1).cast("long"))


def group_ordinals(rows: DataFrame) -> DataFrame:
    """0-based place of a row among those of its block."""
    return rows.withColumn("q", (F.row_number().over(Window.partitionBy("tid", "tag").orderBy("bin_number", "copy")) - 1).cast("long"))


def aligned(rows: DataFrame, p: SetParams) -> DataFrame:
    """Adds ii, and pos in the block: the first side by chunk, the second in cycles of its chunks."""
    rows = copy_ordinals(rows).withColumn("ii", F.col("p") * F.lit(p.slots) + F.col("bin_number"))
    first = F.when(F.col("tid") == 1, F.col("bin_number")).otherwise(F.col("p"))
    then = F.when(F.col("tid") == 1, F.col("p")).otherwise(F.col("bin_number"))
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy("tid", "tag").orderBy(first, then)) - 1).cast("long"))


def stages(a: DataFrame, b: DataFrame, p: SetParams) -> DataFrame:
    """The aligned table that compare() and cost() take."""
    return aligned(expanded(group_dims(padded(chunks(a, b, p), p))), p)


def compare(table: DataFrame) -> DataFrame:
    """Values that rows paired by position share, each once."""
    def side(tid: int, name: str) -> DataFrame:
        return table.where(F.col("tid") == tid).select("tag", "pos", F.col("data").alias(name))

    pairs = side(1, "x").join(side(2, "y"), ["tag", "pos"])
    return pairs.select(F.explode(F.array_intersect("x", "y")).alias("v")).distinct()


def cost(table: DataFrame) -> DataFrame:
    """Rows of one expanded side, dummies included, and comparisons of elements."""
    rows = table.where(F.col("tid") == 1).agg(F.count("*").alias("expanded_rows"), F.coalesce(F.max(F.size("data")), F.lit(0)).cast("long").alias("chunk_size"))
    return rows.withColumn("comparisons", F.col("chunk_size") * F.col("chunk_size") * F.col("expanded_rows"))
