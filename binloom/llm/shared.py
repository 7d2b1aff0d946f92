"""What several operators of this subpackage share: words, row packing, shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python worker takes apart at once; a longer text is taken alone.
TEXT_BYTES = 4 << 20


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the non-white-space runs of a text; null gives an empty array."""
    return F.filter(F.split(text_or_empty(text), WORD_BREAK, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without keeping them: the pieces of a split less an empty first and last piece."""
    trimmed = F.btrim(text_or_empty(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0).cast("long")).otherwise(F.size(F.split(trimmed, WORD_BREAK, -1)).cast("long"))


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices whose texts have that many bytes together at most, or are one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from spark.checkpoint.dir.

    Only a local master, as in tests, may go without that setting; it then gets a folder of its own.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        place = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if place is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="binloom-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", place)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(place)
    return place


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: a short lineage that outlives executors. dropped() removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Removes tables that stored() wrote, through the file system that holds them. For tables that no plan to come reads."""
    for df in frames:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
