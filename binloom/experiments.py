"""Whole experiments: load two parties' records, score all parameter sets at all sample sizes, write the table; and runs of set intersection with their metrics."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from binloom.functions.text import key_text
from binloom.operators import evaluate, minhash, scans, staged
from binloom.plans.params import LinkageParams, SetParams
from binloom.sources import records, storage

# The parameter sets and sizes of the linkage experiment, the sizes and runs of the intersection experiment.
GRID = [LinkageParams(bins, 2, bands) for bins in (1024, 2048) for bands in (8, 16, 32)]
LINKAGE_SIZES = list(range(10_000, 90_001, 10_000))
FIRST_SAMPLE = 100_000
SET_SIZES, SET_BLOCKS, SET_BITS, SET_RUNS = list(range(500, 3_451, 50)), 8, 16, 3


def unused_path(spark: SparkSession, folder: str, name: str, ending: str = "csv") -> str:
    """folder/name_k.ending of the first k from 0 that is not there yet, in any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, k = at.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    while files.exists(spark._jvm.org.apache.hadoop.fs.Path(path := f"{folder}/{name}_{k}.{ending}")):
        k += 1
    return path


def book_records(books: DataFrame) -> DataFrame:
    """(rec_id, text) of books: the isbn tells them apart, title and author are compared."""
    return books.select(F.col("isbn").alias("rec_id"), key_text(F.col("title"), F.col("author")).alias("text"))


def voter_records(voters: DataFrame) -> DataFrame:
    """(rec_id, text) of voters: the ncid tells them apart, names, birth year and birth place are compared; of equal ncids the least text stays."""
    rows = voters.select(F.col("ncid").alias("rec_id"), key_text(*[F.col(c) for c in ("first_name", "last_name", "midl_name", "birth_yr", "birth_place")]).alias("text"))
    return rows.groupBy("rec_id").agg(F.min("text").alias("text"))


def voter_sample(spark: SparkSession, source: str, n: int, path: str, encoding: str = "UTF-16LE") -> DataFrame:
    """The first n voters of a snapshot, written once and read from then on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        records.write_voters(records.sample_voters(records.read_voters(spark, source, encoding), n), path)
    return records.read_sampled_voters(spark, path)


def linkage_experiment(left: DataFrame, right: DataFrame, grid: list[LinkageParams] | None = None, sizes: list[int] | None = None) -> DataFrame:
    """The experiment table of two parties' (rec_id, text): a row per sample size (whole tables without sizes) and parameter set."""
    grid = grid or GRID
    longest = max(grid, key=lambda p: p.permutations)
    return evaluate.sweep(minhash.signature(left, longest), minhash.signature(right, longest), grid, sizes, ids=(left, right))


def sampled_voters(spark: SparkSession, source: str, n: int, folder: str, name: str) -> DataFrame:
    """The first n voters of a snapshot; samples are files of the folder, and one of FIRST_SAMPLE voters serves all smaller ones."""
    if n < FIRST_SAMPLE:
        voter_sample(spark, source, FIRST_SAMPLE, f"{folder}/{name}_{FIRST_SAMPLE}.txt")
        return scans.first_rows(records.read_sampled_voters(spark, f"{folder}/{name}_{FIRST_SAMPLE}.txt"), ["ncid", "first_name", "midl_name", "last_name", "age", "birth_place"], n)
    return voter_sample(spark, source, n, f"{folder}/{name}_{n}.txt")


def run_linkage(spark: SparkSession, kind: str, left: str, right: str, folder: str, grid: list[LinkageParams] | None = None, sizes: list[int] | None = None) -> str:
    """Loads books or voters, runs the experiment and writes its table under the first unused name, which it returns. Voters are sampled if there are sizes."""
    if kind == "books":
        one, other = (storage.stored(book_records(records.read_books(spark, path)), "records") for path in (left, right))
    else:
        read = lambda path, name: sampled_voters(spark, path, max(sizes), folder, name) if sizes else records.read_voters(spark, path)
        one, other = (storage.stored(voter_records(read(path, name)), "records") for path, name in ((left, "left"), (right, "right")))
    path = unused_path(spark, folder, f"{kind}_exp")
    records.write_results(linkage_experiment(one, other, grid, sizes).coalesce(1), path)
    return path


def run_products(spark: SparkSession, left: str, right: str, mapping: str, folder: str, grid: list[LinkageParams] | None = None, match: Callable[[Column, Column], Column] | None = None) -> str:
    """Links two shops' products, whose known pairs a mapping lists: writes these with both texts, and a row of scores per parameter set. Returns the scores' path.

    A pair in one bin is linked if it is known, or if `match` says so of the texts.
    """
    one, other = (records.read_products(spark, path, *names).select(F.col(names[0]).alias("rec_id"), F.col("description").alias("text")) for path, names in ((left, ("idAmazon", "title")), (right, ("idGoogleBase", "name"))))
    listed = records.read_mapping(spark, mapping, "idAmazon", "idGoogleBase").select(F.col("idAmazon").alias("left_id"), F.col("idGoogleBase").alias("right_id"))
    with_left = listed.join(one.select(F.col("rec_id").alias("left_id"), F.col("text").alias("left_text")), "left_id")
    known = with_left.join(other.select(F.col("rec_id").alias("right_id"), F.col("text").alias("right_text")), "right_id").select("left_id", "right_id", "left_text", "right_text")
    known = storage.stored(known, "known")
    records.write_results(known, unused_path(spark, folder, "products_known"))
    rows = None
    for p in grid or GRID:
        row = evaluate.scores(one, other, lambda d, p=p: minhash.minhash_bins(d, p), match, known=known).select(F.lit(p.bins_per_band).alias("num_bins_per_duplicate"), F.lit(p.per_band).alias("num_permutations_per_hash"), F.lit(p.bands).alias("num_duplicates"), "*")
        rows = row if rows is None else rows.unionAll(row)
    path = unused_path(spark, folder, "products_exp")
    records.write_results(rows.coalesce(1), path)
    return path


def hash_lines(spark: SparkSession, source: str, path: str, p: LinkageParams | None = None) -> dict[str, float]:
    """Writes the signature of each different line of text files; how many there are and the mean seconds that one took, counted in the run that writes."""
    lines = records.read_lines(spark, source).distinct()
    seen = Observation("signatures")
    signatures = minhash.signature(lines.withColumn("rec_id", F.col("text")), p or GRID[0]).observe(seen, F.count(F.lit(1)).alias("rows"))
    _, wall, _ = timed(lambda: signatures.write.parquet(path))
    rows = seen.get["rows"]
    return {"rows": rows, "mean_seconds": wall / rows if rows else 0.0}


def timed(run: Callable[[], object]) -> tuple[object, float, float]:
    """What run() gives, its wall seconds and the driver's CPU seconds."""
    wall, cpu = time.perf_counter(), time.process_time()
    out = run()
    return out, time.perf_counter() - wall, time.process_time() - cpu


def intersect_once(a: DataFrame, b: DataFrame, p: SetParams, path: str) -> dict[str, float]:
    """Writes the intersection, in rising order, as text files that follow each other, and gives the metrics of the run.

    total_time and cpu_time are of the whole run, as the driver sees it; staging_cpu is the CPU time of its first half.
    """
    wall, cpu = time.perf_counter(), time.process_time()
    table = staged.stages(a, b, p).persist()
    try:
        comparisons = float(staged.cost(table).first().comparisons)
        half = time.process_time()
        storage.write_in_order(staged.compare(table).withColumn("value", F.col("v").cast("string")), path, ["v"], kind="text", keep=["value"])
        return {"total_time": time.perf_counter() - wall, "cpu_time": time.process_time() - cpu, "staging_cpu": half - cpu, "number_comparison": comparisons}
    finally:
        table.unpersist()


def metric_lines(metrics: dict[str, float]) -> list[str]:
    """Lines that records.parse_metrics reads back."""
    return [f"{name}: {int(value) if name.startswith('number') else value}" + (" seconds" if name.endswith("time") else "") for name, value in metrics.items()]


def run_sets(spark: SparkSession, folder: str, sizes: Iterable[int] = SET_SIZES, blocks: int = SET_BLOCKS, bits: int = SET_BITS, runs: int = SET_RUNS, seed: int = 1) -> str:
    """Intersects two random sets of each size, so many times; writes each run's result and metrics as text and one row per run, without a header:
    size, blocks, wall time of the whole run, the driver's CPU time of staging and of the rest, comparisons. Returns the table's path.

    One process runs both sides here, so there is one wall time and no mean of two.
    """
    rows = []
    for n in sizes:
        for k in range(runs):
            p, at = SetParams(blocks, bits), seed + 2 * k
            a, b = (records.random_integers(spark, n, bits, at + side) for side in (0, 1))
            metrics = intersect_once(a, b, p, unused_path(spark, folder, f"found_{n}_{at}", "txt"))
            lines = spark.createDataFrame([(x,) for x in metric_lines({m: v for m, v in metrics.items() if m != "staging_cpu"})], "value string")
            lines.coalesce(1).write.text(unused_path(spark, folder, f"run_{n}_{at}", "txt"))
            rows.append((n, blocks, round(metrics["total_time"], 4), metrics["staging_cpu"], metrics["cpu_time"] - metrics["staging_cpu"], int(metrics["number_comparison"])))
    path = unused_path(spark, folder, "sets_exp")
    table = spark.createDataFrame(rows, "num_eles long, num_bins int, total_time double, staging_cpu double, other_cpu double, comparisons long")
    records.write_results(table.coalesce(1), path, header=False)
    return path
