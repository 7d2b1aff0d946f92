"""Readers and writers of records, integer sets and results. No type is inferred: columns of CSV files are strings, found by header names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.functions.numbers import permuted
from binloom.operators import scans
from binloom.sources import pieces

BOOK = ["isbn", "title", "author_first_name", "author_last_name"]
VOTER = ["ncid", "first_name", "midl_name", "last_name", "age", "birth_place", "snapshot_dt"]


def read_books(spark: SparkSession, path: str, piece: int = pieces.PIECE) -> DataFrame:
    """A JSON array of four-element arrays, read in pieces; of equal isbn the first in the file stays."""
    rows = pieces.json_elements(spark, path, piece).select("pos", F.from_json("value", "array<string>").alias("r"))
    rows = rows.select("pos", *[F.get("r", F.lit(i)).alias(c) for i, c in enumerate(BOOK)])
    first = rows.groupBy("isbn").agg(F.min_by(F.struct(*BOOK[1:]), "pos").alias("b")).select("isbn", "b.*")
    return first.withColumn("author", F.concat("author_first_name", "author_last_name"))


def write_books(books: DataFrame, path: str) -> None:
    """One array per line, which read.json and line tools take."""
    books.select(F.to_json(F.array(*BOOK)).alias("value")).write.text(path)


def read_voters(spark: SparkSession, path: str, encoding: str = "UTF-16LE") -> DataFrame:
    """Tab-separated snapshot, by header names: needed columns, and birth_yr from the snapshot's year and age."""
    options = {"sep": "\t", "encoding": encoding, "header": True, "quote": '"', "lineSep": "\n"}
    raw = spark.read.options(**options).csv(path)
    rows = raw.select(*[F.regexp_replace(F.col(f"`{c}`"), "\r$", "").alias(c) for c in VOTER])
    year = F.substring("snapshot_dt", 1, 4).cast("int") - F.col("age").cast("int")
    return rows.withColumn("birth_yr", year.cast("string"))


def sample_voters(voters: DataFrame, n: int) -> DataFrame:
    """Whole rows only, each once, the first n by ncid, by a bound and not by a limit; duplicates of an ncid may stay, as the sample precedes that."""
    kept = ["ncid", "first_name", "midl_name", "last_name", "age", "birth_place"]
    return scans.first_rows(voters.na.drop(subset=kept).dropDuplicates(kept), kept, n)


def write_voters(voters: DataFrame, path: str) -> None:
    """Voters as tab-separated text with a header, the columns that they have, as read_sampled_voters reads them."""
    voters.write.options(sep="\t", header=True, quote='"').csv(path)


def read_sampled_voters(spark: SparkSession, path: str) -> DataFrame:
    """What write_voters wrote, all columns as strings; empty values are null."""
    return spark.read.options(sep="\t", header=True, quote='"').csv(path)


def read_products(spark: SparkSession, path: str, id_col: str, name_col: str) -> DataFrame:
    """Id and description, which is name and description together; rows with a null go."""
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    return raw.select(id_col, name_col, "description").na.drop().select(id_col, F.concat(name_col, "description").alias("description"))


def read_mapping(spark: SparkSession, path: str, left_col: str, right_col: str) -> DataFrame:
    """Pairs of ids that are known to be the same; rows with a null go."""
    return spark.read.options(header=True, quote='"', escape='"').csv(path).select(left_col, right_col).na.drop()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): the lines of text files."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_integers(spark: SparkSession, path: str, n: int | None = None, piece: int = pieces.PIECE) -> DataFrame:
    """(pos, v): white-space-separated integers of a file, read in pieces, the first n if given."""
    return pieces.integers(spark, path, n, piece)


def random_integers(spark: SparkSession, n: int, bits: int, seed: int = 1) -> DataFrame:
    """n different integers of `bits` bits, 2**bits - 1 included: the images of 0 to n - 1 under a keyed permutation, so n rows and no sort."""
    if n > 1 << bits:
        raise ValueError(f"there are only {1 << bits} such integers")
    return spark.range(n).select(permuted(F.col("id"), bits, seed).alias("v"))


def write_results(rows: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    """Result rows as CSV; an existing path is an error."""
    rows.write.mode("errorifexists").options(header=header, sep=sep, quote="|").csv(path)


def parse_metrics(lines: DataFrame, value: str = "value") -> DataFrame:
    """(metric, number) of lines `name: number unit`."""
    return lines.select(F.regexp_extract(value, r"^\s*(\w+):", 1).alias("metric"), F.regexp_extract(value, r":\s*([0-9.]+)", 1).cast("double").alias("number")).where("metric <> ''")


def sent_bytes(lines: DataFrame, value: str = "value") -> DataFrame:
    """Bytes in all `Total Sent` entries of a log."""
    sent = F.explode(F.regexp_extract_all(value, F.lit(r"Total Sent[^0-9]*([0-9]+)"), F.lit(1)))
    return lines.select(sent.alias("n")).agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("bytes"))
