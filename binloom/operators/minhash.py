"""Banded MinHash over character shingles.

Signatures are made where the records lie, in Arrow batches: the shingles of some texts are numbered, each different one
is hashed once, and the permutations are minima over numbers. No shingle leaves its task; what moves is one row of
`permutations` numbers per record. Records without a shingle get the greatest value in every permutation and so meet
each other, as records with equal texts do.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.functions.numbers import affine_bin
from binloom.plans.params import MODULUS, LinkageParams

#: Shingles that a task takes apart at once; a longer text is taken in parts.
AT_ONCE = 1 << 20
#: Bits of a place among them; numbers of shingles have what 64-bit integers leave.
PLACE_BITS = 21
#: Ready tokens that are taken at once, and records; each token is an object of its own for a while.
TOKENS, RECORDS = 1 << 17, 256
#: Hashes of shingles that a task remembers, and those of the last ones beyond; about 200 bytes each.
REMEMBERED = 1 << 17


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of few splits to all cores before heavy work; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shingle_hash(shingle: bytes) -> int:
    """28 bits of the MD5, as functions.text.gram_hash gives."""
    return int.from_bytes(md5(shingle, usedforsecurity=False).digest()[:4], "big") >> 4


def _numbered(points: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n code points, equal for equal runs alone."""
    seen = np.zeros(0x110000, np.int64)
    seen[points] = 1
    kinds = int(seen.sum())
    code = (np.cumsum(seen) - 1)[points]
    run, most = code[: len(code) - n + 1], kinds
    for k in range(1, n):
        if most > (1 << (62 - PLACE_BITS)) // kinds:
            names, run = np.unique(run, return_inverse=True)
            most = len(names)
        run, most = run * kinds + code[k : len(code) - n + 1 + k], most * kinds
    return run


def _places(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different number, and which of them each place holds: by sorting numbers with their places."""
    key = np.sort((run << PLACE_BITS) + np.arange(len(run)))
    place, number = key & ((1 << PLACE_BITS) - 1), key >> PLACE_BITS
    new = np.concatenate([[True], number[1:] != number[:-1]])
    which = np.empty(len(run), np.int64)
    which[place] = np.cumsum(new) - 1
    return place[new], which


class Minima:
    """Least value of each permutation over the shingles of each record of a batch. Hashes are remembered from batch to batch."""

    def __init__(self, p: LinkageParams) -> None:
        self.n, self.coefficients, self.known = p.shingle, p.coefficients, {}

    def _hashes(self, shingles: list) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = np.empty(len(shingles), np.int64)
        for k, s in enumerate(shingles):
            if (h := self.known.get(s)) is None:
                h = self.known[s] = shingle_hash(s.encode("utf-8") if isinstance(s, str) else s)
            out[k] = h
        return out

    def _lower(self, out: np.ndarray, hashes: np.ndarray, which: np.ndarray, owner: np.ndarray) -> None:
        """Lowers the rows of out by the hashes' numbers `which` of records `owner`, both in the records' order."""
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows = owner[starts]
        for k, (a, b) in enumerate(self.coefficients):
            least = np.minimum.reduceat(((hashes * a + b) % MODULUS)[which], starts)
            out[k, rows] = np.minimum(out[k, rows], least)

    def of_texts(self, texts: list[bytes | None]) -> np.ndarray:
        """Permutations by texts, of which AT_ONCE shingles are taken apart at a time."""
        out = np.full((len(self.coefficients), len(texts)), MODULUS - 1, np.int64)
        waiting, held = [], 0
        for row, text in enumerate(texts):
            line = (text or b"").decode("utf-8", "replace")
            for at in range(0, len(line) - self.n + 1, AT_ONCE):
                waiting.append((row, line[at : at + AT_ONCE + self.n - 1]))
                held += len(waiting[-1][1])
                if held >= AT_ONCE:
                    self._lower_by(out, waiting)
                    waiting, held = [], 0
        if waiting:
            self._lower_by(out, waiting)
        return out

    def _lower_by(self, out: np.ndarray, parts: list[tuple[int, str]]) -> None:
        line = "".join(t for _, t in parts)
        run = _numbered(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32), self.n)
        lengths = np.array([len(t) for _, t in parts])
        last = np.repeat(np.cumsum(lengths) - self.n, lengths)[: len(run)]
        inside = np.flatnonzero(np.arange(len(run)) <= last)
        owner = np.repeat([row for row, _ in parts], lengths)[inside]
        first, which = _places(run[inside])
        self._lower(out, self._hashes([line[i : i + self.n] for i in inside[first].tolist()]), which, owner)

    def of_tokens(self, lists: pa.ListArray) -> np.ndarray:
        """Permutations by lists of ready tokens; null tokens say nothing."""
        out = np.full((len(self.coefficients), len(lists)), MODULUS - 1, np.int64)
        for first in range(0, len(lists), RECORDS):
            some = lists.slice(first, RECORDS)
            tokens, lengths = some.flatten(), some.value_lengths().fill_null(0).to_numpy()
            owner = first + np.repeat(np.arange(len(some)), lengths)
            for at in range(0, len(tokens), TOKENS):
                part = tokens.slice(at, TOKENS)
                kept = part.is_valid().to_numpy(zero_copy_only=False)
                if kept.any():
                    coded = part.drop_null().dictionary_encode()
                    self._lower(out, self._hashes(coded.dictionary.to_pylist()), coded.indices.to_numpy(), owner[at : at + TOKENS][kept])
        return out


def signature(records: DataFrame, p: LinkageParams, id_col: str = "rec_id", text: str = "text") -> DataFrame:
    """id and p0, p1, ...: `text` is a string or an array of ready tokens. Rows that repeat an id are one record."""
    ready = records.schema[text].dataType.simpleString().startswith("array")
    names = [f"p{k}" for k in range(p.permutations)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(p)
        for batch in batches:
            column = batch.column(1)
            least = minima.of_tokens(column) if ready else minima.of_texts(column.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, least)], ["__id", *names])

    source = records.select(F.col(id_col).alias("__id"), F.col(text).cast("array<binary>" if ready else "binary"))
    kind = records.schema[id_col].dataType.simpleString()
    made = source.mapInArrow(run, f"__id {kind}, " + ", ".join(f"{x} long" for x in names))
    return made.groupBy(F.col("__id").alias(id_col)).agg(*[F.min(x).alias(x) for x in names])


def _sums(p: LinkageParams, prefix: str = "") -> list[Column]:
    return [sum((F.col(f"{prefix}p{i * p.per_band + k}") for k in range(1, p.per_band)), F.col(f"{prefix}p{i * p.per_band}")) for i in range(p.bands)]


def bin_array(p: LinkageParams, prefix: str = "") -> Column:
    """Array of (band, bin) of a signature's row, whose columns may have a prefix."""
    return F.array(*[F.struct(F.lit(i).alias("band"), affine_bin(s, p.bins_per_band, i * p.bins_per_band).alias("bin")) for i, s in enumerate(_sums(p, prefix))])


def shares_bin(p: LinkageParams, one: str, other: str) -> Column:
    """Whether two signatures side by side, their columns told apart by a prefix, share a bin. A band's bins are a bijection of residues."""
    same = [F.pmod(x, F.lit(p.bins_per_band)) == F.pmod(y, F.lit(p.bins_per_band)) for x, y in zip(_sums(p, one), _sums(p, other), strict=True)]
    return F.greatest(*same) if len(same) > 1 else same[0]


def bins_of(signatures: DataFrame, p: LinkageParams, id_col: str = "rec_id") -> DataFrame:
    """id, band, bin: one row per band. Signatures of a longer family serve shorter ones."""
    return signatures.select(id_col, F.inline(bin_array(p)))


def minhash_bins(records: DataFrame, p: LinkageParams, id_col: str = "rec_id", text: str = "text") -> DataFrame:
    return bins_of(signature(records, p, id_col, text), p, id_col)
