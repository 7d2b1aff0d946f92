"""Ranked lexical search, score at a time over postings in order of impact.

A posting's impact is what its term adds to the score of its document, a whole number. Texts are read once: each document
leaves its number of terms and the frequencies of those of its terms that any item asks for. From these come the counts of
the corpus, and then documents are searched shard by shard, a shard being as many documents as have SHARD postings. In a
shard each term's postings are grouped by exact impact. For an item, the groups of its terms are taken in descending
impact, down to one level for all terms after the other, and added to the documents' scores. What is left of each term
is no more than its next group, so:

* a document has at most its score so far and what is left of all terms;
* once that is less than the k-th best score (so far, or of an earlier shard of the task) for all but a few documents,
  nothing more is read. Those documents' scores are then completed from their own term lists, which is exact.

Every document is in one shard, and each task gives its k best of each item, so the best k of these are the best of all.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from binloom.llm.shared import dropped, shared_dir, slices, stored, text_or_empty

#: Bytes of terms: digits, letters and all of UTF-8 beyond ASCII. Others part terms; A-Z become a-z.
_OF_TERMS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256)).lower()
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Postings of a shard, bytes of a text that are taken apart at once, and bytes of items that one pass over the documents serves.
SHARD, PIECE, ITEM_BYTES = 1 << 22, 1 << 20, 8 << 20
#: Each level is this part of the one before it; when so few documents are left for each of the k, their scores are completed.
STEP, LEFT = 0.7, 8


def counted(text: bytes | None) -> Counter[bytes]:
    """How often each term is in a UTF-8 text, which is taken apart in pieces that end between terms."""
    out: Counter[bytes] = Counter()
    start, size = 0, len(text or b"")
    while start < size:
        end = start + PIECE
        if end < size:
            end = gap.start() if (gap := _BREAK.search(text, end)) else size
        out.update(text[start:end].translate(_OF_TERMS).split())
        start = end
    return out


def _postings(wanted: dict[bytes, int]):
    """(id, n, terms, tfs) of each document with a term: how many it has, and the wanted ones by number with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            at, n, ends, terms, tfs = [], [], [0], [], []
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                found = counted(text.as_py())
                if not found:
                    continue
                own = sorted((t, c) for w, c in found.items() if (t := wanted.get(w)) is not None)
                at.append(k)
                n.append(found.total())
                terms += [t for t, _ in own]
                tfs += [c for _, c in own]
                ends.append(len(terms))
            if at:
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], ["id", "n", "terms", "tfs"])

    return run


class Shard:
    """Postings of some documents: by term in descending impact, and by document as they came."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, documents: int, total: int) -> None:
        # total, the documents' terms with repeats, is 1 at least; 25 * n * documents stays under 2**63 for 10**12 documents of 10**5 terms
        long = 75 + 25 * n * documents // total
        doc = np.repeat(np.arange(len(n), dtype=np.int32), counts)
        self.size = len(n)
        self.terms, self.impacts = terms, weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 12 * long[doc]))
        self.ends = np.concatenate([[0], np.cumsum(counts)])
        order = np.lexsort((doc, -self.impacts, terms))
        self.docs, self.sorted = doc[order], self.impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def complete(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, from their own terms. wanted: how often the item has each term."""
        lengths = self.ends[docs + 1] - self.ends[docs]
        before = np.cumsum(lengths) - lengths
        at = np.repeat(self.ends[docs] - before, lengths) + np.arange(lengths.sum())
        gains = wanted[self.terms[at]] * self.impacts[at]
        sums = np.concatenate([[0], np.cumsum(gains)])
        return sums[before + lengths] - sums[before]

    def best(self, terms: np.ndarray, times: np.ndarray, wanted: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read): all that can be among the k best with a score of `least` or more, scores whole."""
        at, end = self.starts[terms], self.starts[terms + 1]
        score, met = np.zeros(self.size, np.int64), np.zeros(self.size, bool)
        left = np.array([t * self.sorted[a] if a < e else 0 for a, e, t in zip(at, end, times, strict=True)], np.int64)
        read, level, rest = 0, int(left.max(initial=0)), None
        at = at.copy()
        while left.any():
            level = min(int(level * STEP), int(left.max()))
            for j in np.flatnonzero(left >= max(level, 1)).tolist():
                # groups of equal impact are never cut: all that is level or more
                own = self.sorted[at[j] : end[j]]
                upto = int(np.searchsorted(-own * times[j], -level, side="right"))
                docs = self.docs[at[j] : at[j] + upto]
                score[docs] += times[j] * own[:upto]
                met[docs] = True
                read += upto
                at[j] += upto
                left[j] = times[j] * self.sorted[at[j]] if at[j] < end[j] else 0
            remaining = int(left.sum())
            bar = max(least, int(np.partition(score, self.size - k)[self.size - k]) if self.size >= k else 0)
            if remaining < max(bar, 1) or not remaining:
                rest = np.flatnonzero(met & (score + remaining >= max(bar, 1)))
                if len(rest) <= LEFT * k or not remaining:
                    break
        if rest is None:
            return np.empty(0, np.int64), np.empty(0, np.int64), read
        return rest, self.complete(rest, wanted), read


def _searched(items: list[tuple[object, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, total: int, k: int, id_type: pa.DataType):
    """(item, id, score): of each item the k best of the task's documents, all that tie with the last of them by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, object]]] = [[] for _ in items]
        wanted = np.zeros(len(weights), np.int64)

        def search(rows: list[pa.RecordBatch]) -> None:
            part = pa.Table.from_batches(rows).combine_chunks()
            ids, n, terms, tfs = (part.column(c).chunk(0) if part.column(c).num_chunks else part.column(c).combine_chunks() for c in range(4))
            shard = Shard(n.to_numpy(), terms.value_lengths().to_numpy().astype(np.int64), terms.flatten().to_numpy(), tfs.flatten().to_numpy(), weights, documents, total)
            for j, (_, own, times) in enumerate(items):
                wanted[own] = times
                least = best[j][-1][0] if len(best[j]) == k else 1
                docs, scores, _ = shard.best(own, times, wanted, k, least)
                wanted[own] = 0
                if len(docs) > k:  # as many as tie with the k-th
                    keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    docs, scores = docs[keep], scores[keep]
                keep = scores >= least
                found = zip(scores[keep].tolist(), ids.take(pa.array(docs[keep])).to_pylist(), strict=True)
                best[j] = sorted([*best[j], *found], key=lambda x: (-x[0], x[1] is None, x[1]))[:k]

        rows, held = [], 0
        for batch in batches:
            if batch.num_rows:
                rows.append(batch)
                held += len(batch.column(2).flatten())
            if held >= SHARD:
                search(rows)
                rows, held = [], 0
        if rows:
            search(rows)
        at = [j for j, b in enumerate(best) for _ in b]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([i for b in best for _, i in b], id_type), pa.array([s for b in best for s, _ in b], pa.int64())], ["item", "id", "score"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents of the highest scores above 0.

    Null, empty and termless texts have no terms: such documents are not counted, such items find nothing. Texts are
    taken whole, however long. Of equal scores the smaller id is first, a null id last. Rows count each, so rows that
    repeat an id are documents of their own that may fill two ranks, and rows that repeat an item's id are one item, of the
    terms of all of them. Without documents or items there are no rows. Other columns are not read.

    Items are served in blocks of about ITEM_BYTES of text, which bounds what goes to each task; each block is one pass
    over the documents.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    source = docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text"))
    asked = items.select(items[item_col].alias("item"), F.encode(text_or_empty(items[item_text]), "UTF-8").alias("text"))
    kinds = dict(source.dtypes) | {"item": dict(asked.dtypes)["item"]}
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ITEM_BYTES))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = None
    for b in range(blocks):
        own = _search_block(source, asked.where(block == b), k, kinds)
        found = own if found is None else found.unionAll(own)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _search_block(source: DataFrame, asked: DataFrame, k: int, kinds: dict[str, str]) -> DataFrame:
    spark = source.sparkSession
    counts: dict[object, Counter[bytes]] = {}
    for r in asked.collect():
        counts.setdefault(r["item"], Counter()).update(counted(bytes(r.text)))
    wanted = {w: t for t, w in enumerate(sorted(set().union(*counts.values())))}
    postings = stored(spark, source.mapInArrow(_postings(wanted), f"id {kinds['id']}, n long, terms array<int>, tfs array<long>"), "postings")
    whole = postings.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    df = {r.term: r.df for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weights = np.array([weight(whole.documents, df.get(t, 0)) for t in range(len(wanted))], np.int64)
    items = [(i, np.array([wanted[w] for w in c], np.int64), np.array(list(c.values()), np.int64)) for i, c in counts.items() if c]
    id_type = to_arrow_type(postings.schema["id"].dataType)
    out = postings.mapInArrow(_searched(items, weights, whole.documents, max(whole.total, 1), k, id_type), f"item int, id {kinds['id']}, score long")
    out = stored(spark, out, "found")
    dropped(postings)
    names = spark.createDataFrame([(j, i) for j, (i, _, _) in enumerate(items)], f"__j int, __name {kinds['item']}")
    return out.join(F.broadcast(names), F.col("item") == F.col("__j")).select(F.col("__name").alias("item"), "id", "score")
