"""Vectors as short codes: product quantisation in exact integers, screened in single precision.

A vector's components become integers, its parts are quantised each by a codebook of its own. Codebooks are learnt by
rounds of assignment and means, all in integers, so that every order of rows, partitions and machines gives the same.

The nearest entry is found in two steps. A single-precision matrix product gives all distances of a batch to all entries,
each with an interval that the true distance can't leave whatever the order of summation. An entry whose interval lies
above the upper end of another one's is out. Where more than one is left, distances are counted in 64-bit integers, and
equal ones go to the lowest index.

A round is one pass over the stored integers: tasks send count and sums of each entry, as many numbers as the codebooks
have, whatever the rows. Only codebooks (entries x components) are ever on the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm.shared import dropped, shared_dir, stored
from binloom.llm.vectors import finite, matrix

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that are screened at once.
ROWS = 8192
_UNIT, _LONGEST = 2.0**-24, 2**63 - 1


def largest_integer(length: int) -> int:
    """Components are held to this size, so that squared distances of whole vectors stay 64-bit integers."""
    return math.isqrt(_LONGEST // length) // 2 - 1


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the place of the nearest entry and its squared distance, and how many rows integers had to settle.

    Both are 64-bit integers. The screened value is |c|^2 - 2xc, which orders entries as distances do. Turning x and c to
    single precision and summing d products errs by g * sum|x||c| at most, g = nu / (1 - nu), n = d + 2, u = 2^-24, in any
    order of summation, fused or not; |x||c| of the norms is no less than that sum. What double precision adds is covered by 2^-50.
    """
    n = x.shape[1] + 2
    wide = n * _UNIT / (1 - n * _UNIT)
    square = (entries * entries).sum(axis=1)
    product = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(square.astype(np.float64))[None, :]
    near = square.astype(np.float64)[None, :] - 2.0 * (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    slack = (2 * wide * product + 2.0**-50 * (square[None, :] + 2 * product)) * (1 + 2.0**-20)
    open_ = near - slack <= (near + slack).min(axis=1)[:, None]
    place = open_.argmax(axis=1)
    unsure = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(unsure):
        row, entry = np.nonzero(open_[unsure])
        apart = x[unsure][row] - entries[entry]
        order = np.lexsort((entry, (apart * apart).sum(axis=1), row))
        place[unsure] = entry[order[np.concatenate([[True], np.diff(row[order]) > 0])]]
    apart = x - entries[place]
    return place, (apart * apart).sum(axis=1), len(unsure)


def _cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """Equal consecutive parts; where that can't be, the first ones are longer by one."""
    ends = [k * (length // parts) + min(k, length % parts) for k in range(parts + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def _batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows = batch.slice(start, ROWS)
            yield rows, matrix(rows.column(0), length, np.int64)


def _sums(books: list[np.ndarray], cuts: list[tuple[int, int]]):
    """(part, entry, at, n, total): of each entry and component what this task's rows give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for _, x in _batches(batches, cuts[-1][1]):
            for k, (start, end) in enumerate(cuts):
                place = nearest(x[:, start:end], books[k])[0]
                counts[k] += np.bincount(place, minlength=len(books[k]))
                np.add.at(totals[k], place, x[:, start:end])
        for k, total in enumerate(totals):
            used = np.flatnonzero(counts[k])
            entry, at = (m.ravel() for m in np.meshgrid(used, np.arange(total.shape[1]), indexing="ij"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), k, np.int32)), pa.array(entry.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[k][entry]), pa.array(total[entry, at])], ["part", "entry", "at", "n", "total"])

    return run


def _coded(books: list[np.ndarray], cuts: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _batches(batches, cuts[-1][1]):
            error, places = np.zeros(len(x), np.int64), np.empty((len(x), len(cuts)), np.uint8)
            for k, (start, end) in enumerate(cuts):
                places[:, k], own, _ = nearest(x[:, start:end], books[k])
                error += own
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array([p.tobytes().hex() for p in places], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return run


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: its id, code (two hex digits per part), error, label_error and codebooks_sha256.

    Codebooks start as the parts of the rows with the least ids; of equal ids the least vector is first, null ids come
    last. Rows with a null vector, a null or non-finite component, no component, or another length than the first row's
    are dropped. Repeated rows count each. With fewer rows than `entries` the codebooks are shorter; without rows there is
    no result. Components beyond largest_integer() are held to it, and a label's error beyond 64 bits to the greatest
    long. Ties go to the lower index. A length that `parts` doesn't divide gives longer first parts, and a part without
    components has code 0 and error 0. Other columns, whatever their names, are not read.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries is 1 to 256, parts 1 or more")
    spark = vectors.sparkSession
    shared_dir(spark)
    rows, length = finite(vectors, id_col, vec_col, label_col)
    kinds = dict(rows.dtypes)
    most = float(largest_integer(max(length, 1)))
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale).cast("double"), F.lit(most)), F.lit(-most)).cast("int"))
    # the floor of a huge double is no long, so it is held to the range before and after
    held = F.transform("v", lambda x: F.greatest(F.least(x.cast("double"), F.lit(most)), F.lit(-most)))
    rows = stored(spark, rows.withColumn("v", held).select(whole.alias("q"), "id", F.col("c0").alias("label")), "vectors")
    first = [r.q for r in rows.orderBy(F.col("id").isNull(), "id", "q").limit(entries).collect()]
    if not first:
        return spark.createDataFrame([], f"`{id_col}` {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    cuts = _cuts(length, parts)
    books = [np.array(first, np.int64)[:, start:end] for start, end in cuts]
    for _ in range(rounds):
        sums = rows.select("q").mapInArrow(_sums(books, cuts), "part int, entry int, at int, n long, total long")
        books = [b.copy() for b in books]
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r.part][r.entry, r["at"]] = r.total // r.n
    codes = stored(spark, rows.mapInArrow(_coded(books, cuts), f"id {kinds['id']}, label {kinds['c0']}, code string, error long"), "codes")
    dropped(rows)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    out = codes.join(by_label, codes["label"].eqNullSafe(by_label["of"]))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
