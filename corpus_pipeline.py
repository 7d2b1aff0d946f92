"""A training corpus from raw documents, in stages: quality rules, near duplicates, benchmark passages, secrets, mixture.

Each stage is a function of (spark, docs, sf_dir) that works on all that the stage before kept. All but the last
return the columns of their input; the last adds `copy`, the number of a document's copy.

Odd rows: a null, empty or wordless text fails the quality rules, so it goes in the first stage; texts are read whole,
however long; a null source is a source of its own; documents without an id stay unless a rule speaks against them, and
of rows that repeat an id one stays after the second stage; rows that tie or repeat each other are judged alike. Without
documents each stage gives none; without labels the built-in references hold; without benchmark items none goes for
them. Other columns are kept whatever their names, but for one named `copy`, which the last stage replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm import decontaminate, mixing, ngram_join, quality_rules, secret_scan
from binloom.llm.shared import dropped, stored, table, word_count

#: Words of a shingle, and the similarity in hundredths at which documents are near duplicates.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)
#: Weights of the sources in order, and the most copies of a document.
WEIGHTS, CAP = (5.0, 2.0, 1.0), 3.0


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject; their references and limits come from the documents that are labelled good."""
    return quality_rules.keep_by_labels(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates."""
    return ngram_join.keep_one(docs, SHINGLE_WORDS, SIMILARITY)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; lengths follow."""
    return secret_scan.redact_secrets(docs, length_col="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their weights."""
    return mixing.mix(docs, WEIGHTS, CAP, text_size=word_count(F.col("text")), copy_col="copy")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_documents),
    ("ngram_join", one_of_each),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("source_mixing", mixed),
]

#: Near duplicates need components and the mixture needs hashes that DuckDB lacks; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again; a stage's input goes when its output is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
