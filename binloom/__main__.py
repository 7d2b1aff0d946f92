"""python -m binloom linkage|products|lines|sets|intersect ...: the experiments from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from binloom import experiments
from binloom.plans.params import LinkageParams, SetParams
from binloom.sources import records


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="binloom")
    kinds = top.add_subparsers(dest="what", required=True)
    linkage = kinds.add_parser("linkage", help="score parameter sets on two parties' records")
    linkage.add_argument("kind", choices=["books", "voters"])
    products = kinds.add_parser("products", help="score parameter sets on two shops' products and a mapping of their ids")
    for p in (linkage, products):
        p.add_argument("left")
        p.add_argument("right")
    products.add_argument("mapping")
    linkage.add_argument("-n", "--sizes", type=int, nargs="*", default=experiments.LINKAGE_SIZES)
    for p in (linkage, products):
        p.add_argument("-o", "--out", required=True)
        p.add_argument("-l", "--bins", type=int, nargs="+", default=[1024, 2048])
        p.add_argument("-m", "--per-band", type=int, default=2)
        p.add_argument("-d", "--bands", type=int, nargs="+", default=[8, 16, 32])
    lines = kinds.add_parser("lines", help="write the signatures of the lines of text files")
    lines.add_argument("source")
    lines.add_argument("-o", "--out", required=True)
    sets = kinds.add_parser("sets", help="time the intersection of random sets")
    sets.add_argument("-o", "--out", required=True)
    sets.add_argument("-n", "--sizes", type=int, nargs="+", default=experiments.SET_SIZES)
    sets.add_argument("-r", "--runs", type=int, default=experiments.SET_RUNS)
    intersect = kinds.add_parser("intersect", help="intersect the integers of two files")
    intersect.add_argument("first")
    intersect.add_argument("second")
    intersect.add_argument("-n", "--count", type=int)
    intersect.add_argument("-o", "--out", required=True)
    for p in (sets, intersect):
        p.add_argument("-b", "--blocks", type=int, default=experiments.SET_BLOCKS)
        p.add_argument("-s", "--bits", type=int, default=experiments.SET_BITS)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = _arguments().parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    grid = [LinkageParams(bins, a.per_band, bands) for bins in a.bins for bands in a.bands] if a.what in ("linkage", "products") else []
    if a.what == "linkage":
        out = experiments.run_linkage(spark, a.kind, a.left, a.right, a.out, grid, a.sizes or None)
    elif a.what == "products":
        out = experiments.run_products(spark, a.left, a.right, a.mapping, a.out, grid)
    elif a.what == "lines":
        found = experiments.hash_lines(spark, a.source, a.out)
        out = f"{found['rows']} lines, {found['mean_seconds']} seconds each"
    elif a.what == "sets":
        out = experiments.run_sets(spark, a.out, a.sizes, a.blocks, a.bits, a.runs)
    else:
        first, second = (records.read_integers(spark, path, a.count).select("v").distinct() for path in (a.first, a.second))
        metrics = experiments.intersect_once(first, second, SetParams(a.blocks, a.bits), a.out)
        out = "\n".join(experiments.metric_lines({m: v for m, v in metrics.items() if m != "staging_cpu"}))
    print(out)
    return out


if __name__ == "__main__":
    main()
