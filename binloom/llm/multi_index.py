"""Nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised separately, so K + K centroids cut the space into K x K cells. A query goes through
the cells in order of the summed squared distances of its halves to the cells' centroids, by a heap that only ever holds
the border of what it has seen, until the cells hold as many entries as the search asks for; those entries are then ranked
by the exact distance of the whole vectors.

* **Entries.** Equal vectors have equal distances, and of equal distances only the least ids can be among the k nearest.
  So copies meet as one entry with their k + 1 least ids, combined per task before anything moves. How often a vector is
  repeated costs nothing.
* **How far to search.** Not guessed: a bounded sample of queries is compared with all entries, and the search goes as far
  as it takes for the wanted share of their true neighbours. Data without structure make it go further, not worse.
* **Blocks.** Neighbouring cells make blocks of about ROWS entries, and a cell with more is dealt into several, as are the
  queries that open a block, so a task holds one block of each, however many there are. A query travels once per block,
  with the list of cells that it opens there; other entries of the block are no candidates. Nothing is capped.

On the driver: a sample of rows for the centroids, the measured queries' true neighbours, and the number of entries of each
cell, at most MOST_CENTROIDS squared. All three are bounded whatever the table's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.llm.shared import dropped, shared_dir, stored
from binloom.llm.vectors import finite, matrix

#: Numbers of the sample that centroids are fitted on, rows a cell should have, and centroids of a half at most.
SAMPLE_NUMBERS, CELL_ROWS, MOST_CENTROIDS = 1 << 22, 16, 1024
#: Queries that the depth of the search is measured on, and the share of their true neighbours that it must reach.
MEASURED, WANTED = 256, 0.96
#: Entries and queries of a block.
ROWS, QUERIES = 2048, 1024


def half_centroids(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from the first k points, which the caller has in random order; an empty cluster keeps its centroid."""
    centroids = points[:k].copy()
    for _ in range(rounds):
        place = np.concatenate([squares(points[s : s + 4096], centroids).argmin(axis=1) for s in range(0, len(points), 4096)])
        counts, sums = np.bincount(place, minlength=k), np.zeros_like(centroids)
        np.add.at(sums, place, points)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y, up to rounding."""
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def cells_from(one: np.ndarray, other: np.ndarray) -> Iterator[int]:
    """All cells i * len(other) + j by rising one[i] + other[j]."""
    p, q = np.argsort(one, kind="stable").tolist(), np.argsort(other, kind="stable").tolist()
    a, b, n = one[p].tolist(), other[q].tolist(), len(other)
    border = [(a[0] + b[0], 0, 0)]
    while border:
        _, i, j = heapq.heappop(border)
        yield p[i] * n + q[j]
        if j + 1 < n:
            heapq.heappush(border, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(border, (a[i + 1] + b[0], i + 1, 0))


class Index:
    """Centroids of both halves; what it takes to find a vector's cell and a query's order of cells."""

    def __init__(self, sample: np.ndarray, k: int) -> None:
        self.length, self.cut = sample.shape[1], (sample.shape[1] + 1) // 2
        self.halves = [half_centroids(sample[:, : self.cut], k), half_centroids(sample[:, self.cut :], k)]

    @property
    def cells(self) -> int:
        return len(self.halves[0]) * len(self.halves[1])

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        one, other = squares(x[:, : self.cut], self.halves[0]), squares(x[:, self.cut :], self.halves[1])
        return one.argmin(axis=1) * len(self.halves[1]) + other.argmin(axis=1)

    def order(self, q: np.ndarray) -> Iterator[int]:
        """The cells in a query's order. Distances are summed vector by vector, so that they don't depend on what is searched along with it."""
        one, other = (((c - half) ** 2).sum(axis=1) for c, half in zip(self.halves, (q[: self.cut], q[self.cut :]), strict=True))
        return cells_from(one, other)


def _entries(index: Index, keep: int):
    """(cell, h, v, ids): the vectors of a task, each once, with its least ids. h is a hash of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        seen: dict[bytes, list[int]] = {}
        held = 0

        def given() -> pa.RecordBatch:
            vectors = np.stack([np.frombuffer(v, np.float64) for v in seen])
            flat = pa.ListArray.from_arrays(np.arange(len(seen) + 1, dtype=np.int32) * index.length, pa.array(vectors.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(index.cell_of(vectors).astype(np.int32)), pa.array([xxh3_64_intdigest(v) >> 1 for v in seen], pa.int64()), flat, pa.array(list(seen.values()), pa.list_(pa.int64()))], ["cell", "h", "v", "ids"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), matrix(batch.column(1), index.length) + 0.0, strict=True):
                if (ids := seen.get(key := v.tobytes())) is None:
                    seen[key] = [i]
                    held += len(key)
                elif i not in ids:
                    ids.append(i)
                    if len(ids) > keep:
                        ids.remove(max(ids))
            if held > 1 << 26:
                yield given()
                seen, held = {}, 0
        if seen:
            yield given()

    return run


def _first_k(row: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least (far, id) of each row, an id once."""
    order = np.lexsort((far, ids, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(row[order]) != 0) | (np.diff(ids[order]) != 0)
    order = order[fresh]
    order = order[np.lexsort((ids[order], far[order], row[order]))]
    return order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]


def _ranked(q_ids: np.ndarray, q: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int, opened: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, squared distance, place of the entry) of each query's k nearest of the entries opened to it, its own id left out.

    The matrix product finds who may be among the k + 1 nearest entries of different ids; their distances are then summed component by component.
    """
    far = squares(q, x)
    if opened is not None:
        far[~opened] = np.inf
    held = np.concatenate([np.array(i, np.int64) for i in ids])
    at = min(k + len(held) - len(np.unique(held)), len(x) - 1)  # entries that share an id count once
    most = np.partition(far, at, axis=1)[:, at]
    slack = 1e-9 * ((q * q).sum(axis=1) + (x * x).sum(axis=1).max())
    row, entry = np.nonzero((far <= (most + slack)[:, None]) & (far < np.inf))
    exact = np.zeros(len(row))
    for c in range(q.shape[1]):
        apart = q[row, c] - x[entry, c]
        exact += apart * apart
    count = np.array([len(ids[e]) for e in entry.tolist()], np.int64)
    all_ids = np.array([i for e in entry.tolist() for i in ids[e]], np.int64)
    row, entry, exact = np.repeat(row, count), np.repeat(entry, count), np.repeat(exact, count)
    other = all_ids != q_ids[row]
    row, entry, exact, all_ids = row[other], entry[other], exact[other], all_ids[other]
    order = _first_k(row, all_ids, exact, k)
    return row[order], all_ids[order], exact[order], entry[order]


def _true_neighbours(ids: np.ndarray, q: np.ndarray, k: int):
    """(q, vec_id, far, cell): the k nearest of a task's entries for each measured query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                row, found, far, entry = _ranked(ids, q, matrix(rows.column(2), q.shape[1]), rows.column(3).to_pylist(), k)
                best = tuple(np.concatenate(x) for x in zip(best, (row, found, far, rows.column(0).to_numpy()[entry]), strict=True))
                order = _first_k(*best[:3], k)
                best = tuple(x[order] for x in best)
        yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int32)), *map(pa.array, best[1:])], ["q", "vec_id", "far", "cell"])

    return run


def depth(index: Index, sizes: np.ndarray, q: np.ndarray, wanted_cells: list[list[int]], share: float) -> int:
    """How many entries a search must see to open the cells of this share of the wanted ones."""
    need: list[int] = []
    for vector, cells in zip(q, wanted_cells, strict=True):
        left, seen = list(cells), 0
        for cell in index.order(vector):
            while cell in left:
                left.remove(cell)
                need.append(seen)
            if not left:
                break
            seen += int(sizes[cell])
    need.sort()
    return need[min(len(need) - 1, int(np.ceil(share * len(need))))] + 1 if need else 1


def blocks_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block of each cell, and how many it has: neighbouring cells share one until ROWS entries are in it, a full cell has several for itself."""
    first, many, block, held = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32), 0, 0
    for cell in np.flatnonzero(sizes).tolist():
        n = int(sizes[cell])
        if held and held + n > ROWS:
            block, held = block + 1, 0
        first[cell], many[cell] = block, -(-n // ROWS)
        block, held = (block + int(many[cell]), 0) if n > ROWS else (block, held + n)
    return first, many


def _probes(index: Index, cells, least: int):
    """(id, v, block, cells): each query once for each block of the cells that it opens. Cells are opened until they hold `least` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, first, many = cells.value
        for batch in batches:
            for k, vector in enumerate(matrix(batch.column(1), index.length)):
                opened, seen = [], 0
                for cell in index.order(vector):
                    if sizes[cell]:
                        opened.append(cell)
                        seen += int(sizes[cell])
                        if seen >= least:
                            break
                opened = np.sort(np.array(opened, np.int32))
                block = first[opened]
                starts = np.flatnonzero(np.concatenate([[True], np.diff(block) > 0]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(opened)).astype(np.int32)), pa.array(opened))
                again = np.repeat(np.arange(len(starts)), many[opened[starts]])  # a full cell's list goes to each of its blocks
                place = np.arange(len(again)) - np.searchsorted(again, again)
                at = pa.array(np.full(len(again), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array((block[starts][again] + place).astype(np.int32)), lists.take(pa.array(again))], ["id", "v", "block", "cells"])

    return run


def _reranked(length: int, k: int):
    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        if not len(queries) or not len(entries):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, q = queries.column("id").to_numpy(), matrix(queries.column("v").combine_chunks(), length)
        cells, own = np.unique(entries.column("cell").to_numpy(), return_inverse=True)
        lists = queries.column("cells").combine_chunks()
        listed, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        there = np.isin(listed, cells)
        opened = np.zeros((len(ids), len(cells)), bool)
        opened[row[there], np.searchsorted(cells, listed[there])] = True
        row, found, far, _ = _ranked(ids, q, matrix(entries.column("v").combine_chunks(), length), entries.column("ids").to_pylist(), k, opened[:, own])
        return pa.table({"query_id": pa.array(ids[row]), "vec_id": pa.array(found), "score": pa.array(np.sqrt(far))})

    return run


def _best(found: DataFrame, by: str, score: str, k: int, *more: str) -> DataFrame:
    """The k least scores of each `by`, ties to the lower id, an id once; one exchange, by `by`."""
    once = found.repartition(by).groupBy(by, "vec_id").agg(F.min(score).alias(score), *[F.min_by(c, score).alias(c) for c in more])
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(score, "vec_id"))).where(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, asked: Column, k: int = 10, share: float = WANTED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that meets the condition `asked`, by Euclidean distance.

    ids are integers. Rows take no part, neither as query nor as candidate, if their id is null or their vector is null,
    empty, all zeros, of another length than that of the least id, or holds a null or non-finite component. A candidate
    is every row with another id than the query's; fewer than k give all. Ties in distance go to the smaller id. A
    repeated id counts as candidate by its nearest vector, once, and as query by its least vector. Without queries or
    candidates there are no rows. Columns other than the two named are read by `asked` alone.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    out = "query_id long, rank int, vec_id long, score double"
    flagged = vectors.withColumn("__asked", F.coalesce(asked, F.lit(False)))
    rows, length = finite(flagged, id_col, vec_col, "__asked")
    rows = rows.where(F.col("id").isNotNull() & F.exists("v", lambda x: x != 0)).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), "c0")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], out)
    hashed = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30))

    def about(frame: DataFrame, m: int, most: int) -> list:
        """About `most` of m rows, those of the least hashes of their ids."""
        return sorted(frame.where(hashed < F.lit(min(1 << 30, (most << 30) // max(m, 1)))).select(hashed.alias("h"), "id", "v").collect())

    sample = np.array([r.v for r in about(rows, n, max(256, SAMPLE_NUMBERS // length))], np.float64)
    if not len(sample):
        sample = np.array([rows.first().v], np.float64)
    centroids = min(MOST_CENTROIDS, len(sample), max(1, round((n / CELL_ROWS) ** 0.5)))
    index = Index(sample, centroids)
    entries = stored(spark, rows.select("id", "v").mapInArrow(_entries(index, k + 1), "cell int, h long, v array<double>, ids array<long>"), "entries")
    sizes = np.zeros(index.cells, np.int64)
    for r in entries.groupBy("cell").count().collect():
        sizes[r.cell] = r["count"]

    queries = stored(spark, rows.where("c0").groupBy("id").agg(F.min("v").alias("v")), "queries")
    tried = about(queries, queries.count(), MEASURED)
    least = 1
    if tried:
        q = np.array([r.v for r in tried], np.float64)
        near = entries.mapInArrow(_true_neighbours(np.array([r.id for r in tried], np.int64), q, k), "q int, vec_id long, far double, cell int")
        cells: list[list[int]] = [[] for _ in tried]
        for r in _best(near, "q", "far", k, "cell").collect():
            cells[r.q].append(r.cell)
        least = depth(index, sizes, q, cells, share)

    best = stored(spark, _searched(index, entries, sizes, queries, max(least, k + 1), k), "neighbours")
    # entries that share an id may leave a query with less than it could have; it goes through all cells then
    full = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = stored(spark, queries.join(full, "id", "left_anti"), "short")
    if short.limit(1).count():
        older, again = best, _searched(index, entries, sizes, short, n + 1, k)
        best = stored(spark, older.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again), "neighbours")
        dropped(older)
    dropped(entries, queries, short)
    return best


def _searched(index: Index, entries: DataFrame, sizes: np.ndarray, queries: DataFrame, least: int, k: int) -> DataFrame:
    """The k nearest of each query among the entries of the cells that it opens until they hold `least`."""
    spark = entries.sparkSession
    first, many = blocks_of(sizes)
    counted = spark.sparkContext.broadcast((sizes, first, many))
    probes = stored(spark, queries.mapInArrow(_probes(index, counted, least), "id long, v array<double>, block int, cells array<int>"), "probes")
    # a row per cell that has entries, at most MOST_CENTROIDS squared; blocks are joined as Spark chooses
    held = np.flatnonzero(sizes)
    by_cell = F.broadcast(spark.createDataFrame(pa.table({"cell": held.astype(np.int32), "first": first[held], "many": many[held]})))
    by_block = probes.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qs"))
    placed = entries.join(by_cell, "cell").select("v", "ids", "cell", (F.col("first") + F.pmod("h", F.col("many")).cast("int")).alias("block"))
    asked_blocks = probes.join(by_block, "block").select("id", "v", "cells", "block", F.pmod(F.xxhash64("id"), F.col("qs")).cast("int").alias("qb"))
    entry_blocks = placed.join(by_block, "block").select("v", "ids", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"))
    found = asked_blocks.groupBy("block", "qb").cogroup(entry_blocks.groupBy("block", "qb")).applyInArrow(_reranked(index.length, k), "query_id long, vec_id long, score double")
    return _best(found, "query_id", "score", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
