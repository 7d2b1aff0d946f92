"""A folder that the driver and all executors see, and ordered files in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.operators import scans


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a local master, as in tests, may go without and gets a folder of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="binloom-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_in_order(df: DataFrame, path: str, order: list[str], files: int | None = None, kind: str = "parquet", keep: list[str] | None = None, **options) -> None:
    """Writes df, or its columns `keep`, so that its files, by name, follow each other in the order: a range of keys per file, each sorted.

    Ranges come from Spark's range exchange, so there is no task that holds all rows; `files` is their number, the
    session's shuffle partitions if none is given.
    """
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*(keep or df.columns)).write.format(kind).mode("errorifexists").options(**options).save(path)


def read_in_order(spark: SparkSession, path: str, name: str = "pos") -> DataFrame:
    """Rows of ordered Parquet files with their place in them, from 1: files by name, rows as they stand."""
    rows = spark.read.parquet(path).withColumns({"__scan_file": F.col("_metadata.file_name"), "__scan_row": F.col("_metadata.row_index")})
    return scans.numbered(rows, ["__scan_file", "__scan_row"], name=name).drop("__scan_file", "__scan_row")
