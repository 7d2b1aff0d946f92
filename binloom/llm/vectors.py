"""What the operators on vectors share: which rows take part, and matrices of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(vectors: DataFrame, id_col: str, vec_col: str, *more: str) -> tuple[DataFrame, int]:
    """Rows (id, v, c0, c1, ... of the columns more) whose vector is neither null nor empty and holds finite components alone, and the vectors' length.

    The length is that of the row with the least id (null ids come last; of equal ids the shortest vector counts); rows of
    another length take no part. Without rows the length is 0.
    """
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].alias("v"), *[vectors[c].alias(f"c{k}") for k, c in enumerate(more)])
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & whole)
    first = rows.agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.size("v").alias("n"))).alias("x")).first().x
    return (rows.where(F.size("v") == first.n), first.n) if first is not None else (rows, 0)


def matrix(column: pa.Array, length: int, kind: type = np.float64) -> np.ndarray:
    """The vectors of a column of lists as rows; there is no null in it."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), length)
