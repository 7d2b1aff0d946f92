"""Linkage of a stream of records with a static table; an extension, as batch tables alone are the model."""

from __future__ import annotations

from pyspark.sql import DataFrame


def matched(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Records of the stream whose identity the static table has. Stateless: the table is read per batch."""
    return stream.join(static.select(key).distinct(), key, "left_semi")
