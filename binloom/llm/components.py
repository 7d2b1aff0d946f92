"""Connected components of an edge table by alternating large and small stars.

Every round is joins and minima on the edge table, written to the shared folder so that the lineage
stays short and a lost executor costs one round at most. Hubs are no trouble: minima combine before the
shuffle, and the joins on a node are ones that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm.shared import dropped, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def connected(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge (a, b), as a stored table: label is the least node of its component. Any orderable type."""
    edges = stored(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.unionAll(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(least.select("a", F.col("m").alias("b")))
        older, edges = edges, stored(spark, small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        before, state = state, _state(edges)
        dropped(older)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    labels = stored(spark, labels.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), "labels")
    dropped(edges)
    return labels
