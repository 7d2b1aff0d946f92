"""N-gram Jaccard self-join of documents by count vectors in R-trees.

A document's set is its distinct word n-grams, hashed to 64 bits. Hash groups do two things:

* **Points.** Groups named by the leading bits of the hashes give each set a vector of group counts, as long as the
  set is large (64 coordinates at least, MOST_DIMENSIONS at most); a longer vector folds to a shorter one. Two sets
  share at most the sum of the coordinate minima of their vectors; under the overlap that the threshold asks for, a
  pair is out. `CountTree` is an R-tree over such points: inner nodes hold the largest count of each coordinate,
  which bounds every set below.
* **Shards.** A tree over all documents would not scale: near a threshold, count vectors alone leave a
  constant share of all pairs. So trees are sharded. Sets that link differ in at most K elements, K
  following from their sizes; hashed to more than K groups, some groups are equal in both. Each
  set therefore goes to one shard per group, named by the group's content, for its own size class and
  the next smaller one. No link is lost, and only sets that share a whole group meet.

Equal sets are one class throughout, so exact copies, however many, cost one member. Pairs are asked for in three steps,
and those that verification leaves make components for the next one:

* **Stars.** The least member of a shard with each other one. Near copies share many shards and few least members, so
  most of them are one component before any tree is searched, and a pair is not found again in each of its shards.
* **Forests.** Shards of three members or more that are in different components go to trees, in blocks. A block gives, of
  the pairs that its tree allows, the most alike ones that join its components, fewer than it has members. If none of
  them fails, what the block may link is linked.
* **The rest.** Else its shard gives all pairs of different components that its trees still allow.

Nodes whose members are all in one component are not searched, so a shard of many near copies costs its size and not its
square. Verification compares the hashed sets whole; they are made again from the texts of the classes that are asked
for, and of no others, since all of them are as large as the texts.

Defined results: null, empty or wordless texts have no set, link with nothing, and are their own
component; texts shorter than n words are one shingle of all their words; rows that repeat an id or a
text are members of one class; a null id is nobody's least id unless all ids of a component are null; very long texts are
read whole, their sets travel as 8 bytes a shingle; an empty table gives an empty one; other columns, whatever their
names, are not read by near_duplicates and are kept by keep_one.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binloom.llm.components import connected
from binloom.llm.shared import dropped, shared_dir, stored

DIMENSIONS, MOST_DIMENSIONS = 64, 4096
BLOCK = 1024
#: Rows of an open shard that are held back to see whether its members are those of another one.
HELD_ROWS = 1 << 16
#: Ids up to this many go to each executor whole (at 24 bytes a row, 24 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text's words, A-Z in lower case."""
    from xxhash import xxh3_64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes, lower and split know ASCII only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out) + h[k : len(h) - width + 1 + k]
    return np.unique(_mix(out))


def dimensions(size: int) -> int:
    """Coordinates of the vector of a set: a power of two that is no less than its size, within limits."""
    return min(MOST_DIMENSIONS, max(DIMENSIONS, 1 << max(size - 1, 0).bit_length()))


def count_vector(hashes: np.ndarray) -> np.ndarray:
    n = dimensions(len(hashes))
    counts = np.bincount((hashes >> np.uint64(65 - n.bit_length())).astype(np.int64), minlength=n)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int32)


def folded(vector: bytes, size: int, n: int) -> np.ndarray:
    """n coordinates of a stored vector of a set of that size."""
    own = dimensions(size)
    counts = np.frombuffer(vector, np.uint8 if len(vector) == own else np.int32)
    return counts if own == n else counts.reshape(n, own // n).sum(axis=1, dtype=np.int32)


def needed_overlap(a, b, num: int, den: int):
    """Least overlap of sets of sizes a and b with Jaccard similarity num / den or more."""
    return -((-num * (a + b)) // (num + den))


def _spare_groups(most: int, size: int) -> int:
    """Groups beyond most + 1, so many that sets of the size or more seldom leave more groups empty."""
    spare, cap = 2, 2 + most // 4
    while spare < cap:
        n = most + 1 + spare
        empty = n * math.exp(-size / n)
        wanted = math.ceil(empty + 4 * math.sqrt(empty))
        if spare >= wanted:
            break
        spare = min(wanted, cap)
    return spare


@lru_cache(maxsize=8)
def size_classes(num: int, den: int) -> tuple[list[int], list[int], list[int]]:
    """First size of each class; for links whose smaller set is in it, the groups and how many are spare. A link spans two adjacent classes at most."""
    first, groups, spares = [1], [], []
    while first[-1] < 1 << 40:
        least = first[-1]
        first.append(least * den // num + 1)
        largest = first[-1] - 1
        most = (largest + largest * den // num) * (den - num) // (den + num)
        spares.append(_spare_groups(most, least))
        groups.append(most + 1 + spares[-1])
    return first, groups, spares


def shard_names(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Names of the shards in which a set meets all that it links to, for its own size class and the class below.

    Of K + 1 + s groups, s + 1 at least are equal in linked sets. One that is not empty names a shard. If all of them are
    empty, both sets leave s + 1 groups empty, which is rare, and meet in a shard named by two groups that both leave empty.
    """
    first, groups, spares = size_classes(num, den)
    own = bisect_right(first, len(hashes)) - 1
    mixed, out = _mix(hashes ^ _A), []
    for level in {own, max(own - 1, 0)}:
        n, salt = groups[level], np.uint64(level * int(_B) % 2**64)
        group = (hashes % np.uint64(n)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[order], dtype=np.uint64)])
        ends = np.searchsorted(group[order], np.arange(n + 1))
        held = np.diff(ends)
        content = sums[ends[1:]] - sums[ends[:-1]]
        names = _mix(_mix(content + salt) + np.arange(n, dtype=np.uint64) * _A + held.astype(np.uint64))
        out.append(names[held > 0])
        empty = np.flatnonzero(held == 0).astype(np.uint64)
        if len(empty) > spares[level]:
            i, j = np.triu_indices(len(empty), 1)
            out.append(_mix(_mix(_mix(empty[i] + salt) + empty[j]) ^ _A))
    return np.concatenate(out)


class CountTree:
    """R-tree over count vectors, packed by recursive halving along the coordinate of the largest spread.

    A node: largest count of each coordinate, least size, the label of all rows below or -1, rows of a leaf, children.
    """

    LEAF = 32

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        self.points, self.sizes, self.labels = points, sizes, labels
        self.nodes: list[tuple[np.ndarray, int, int, np.ndarray | None, tuple[int, ...]]] = []
        self.root = self._pack(np.arange(len(points))) if len(points) else -1

    def _pack(self, rows: np.ndarray) -> int:
        p, labels = self.points[rows], self.labels[rows]
        top, below = p.max(axis=0), ()
        if len(rows) > self.LEAF:
            order = rows[np.argsort(p[:, int(np.argmax(top - p.min(axis=0)))], kind="stable")]
            below = self._pack(order[: len(rows) // 2]), self._pack(order[len(rows) // 2 :])
        same = int(labels[0]) if (labels == labels[0]).all() else -1
        self.nodes.append((top, int(self.sizes[rows].min()), same, None if below else rows, below))
        return len(self.nodes) - 1

    def join(self, other: CountTree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, rows of other, overlap bounds) of all pairs of unlike labels that the bound allows. With itself, each pair once."""
        alone = other is self
        open_ = [(self.root, other.root)] if self.root >= 0 and other.root >= 0 else []
        while open_:
            x, y = open_.pop()
            top, least, label, rows, below = self.nodes[x]
            top_y, least_y, label_y, rows_y, below_y = other.nodes[y]
            if label == label_y >= 0 or int(np.minimum(top, top_y).sum(dtype=np.int64)) < needed_overlap(least, least_y, num, den):
                continue
            if alone and x == y and below:
                open_ += [(below[0], below[0]), (below[1], below[1]), below]
            elif below and (rows_y is not None or len(self.nodes) >= len(other.nodes)):
                open_ += [(k, y) for k in below]
            elif below_y:
                open_ += [(x, k) for k in below_y]
            else:
                bound = np.minimum(self.points[rows][:, None, :], other.points[rows_y][None, :, :]).sum(axis=2, dtype=np.int64)
                fits = (bound >= needed_overlap(self.sizes[rows][:, None], other.sizes[rows_y][None, :], num, den)) & (self.labels[rows][:, None] != other.labels[rows_y][None, :])
                if alone and x == y:
                    fits = np.triu(fits, 1)
                i, j = np.nonzero(fits)
                if len(i):
                    yield rows[i], rows_y[j], bound[i, j]


def _class_of(hashes: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes())


def _short(cls: bytes) -> int:
    return int.from_bytes(cls[:8], "big", signed=True)


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) if len(s) else None for s in sets], pa.binary())], ["id", "n", "cls"])

    return run


def _sharded(n: int, num: int, den: int):
    """(shard, short class), each class once per partition: what a map-side combine would leave of copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            shards, classes = [], []
            for t in batch.column(0).to_pylist():
                hashes = shingle_set(t, n)
                if not len(hashes) or (cls := _class_of(hashes)) in seen:
                    continue
                seen.add(cls)
                shards.append(shard_names(hashes, num, den))
                classes.append(np.full(len(shards[-1]), _short(cls)))
            if shards:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards).view(np.int64)), pa.array(np.concatenate(classes))], ["shard", "c"])

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shard, c), the shards of two classes or more: (shard, least class, other class).

    Shards with the same members as one already seen nearby say nothing new and are left out, unless they are so large
    that their rows cannot wait for the last of them.
    """

    def rows(s: np.ndarray, heads: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(heads), pa.array(m)], ["shard", "head", "c"])

    seen: set[int] = set()
    shard, c = np.empty(0, np.int64), np.empty(0, np.int64)
    flowing: tuple[int, int, int] | None = None  # of a large shard: its name, head and last class
    for batch in _with_end(batches):
        if batch is not None:
            shard, c = np.concatenate([shard, batch.column(0).to_numpy()]), np.concatenate([c, batch.column(1).to_numpy()])
        if not len(shard):
            continue
        if flowing:
            own = int(np.searchsorted(shard != flowing[0], True))
            m, shard, c = c[:own], shard[own:], c[own:]
            m = m[np.concatenate([[flowing[2]], m[:-1]]) != m] if own else m
            if len(m):
                yield rows(np.full(len(m), flowing[0]), np.full(len(m), flowing[1]), m)
                flowing = (flowing[0], flowing[1], int(m[-1]))
            if len(shard):
                flowing = None
            else:
                continue
        cut = len(shard) if batch is None else int(np.searchsorted(shard == shard[-1], True))
        s, m = shard[:cut], c[:cut]
        shard, c = shard[cut:], c[cut:]
        if len(s):
            keep = np.concatenate([[True], (s[1:] != s[:-1]) | (m[1:] != m[:-1])])
            s, m = s[keep], m[keep]
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            lengths = np.diff(np.append(starts, len(s)))
            lists = np.add.reduceat(_mix(m.view(np.uint64)), starts)
            many = np.flatnonzero(lengths > 1)
            if len(seen) > 1_000_000:
                seen.clear()
            new = [i for i in many if (key := int(lists[i])) not in seen and not seen.add(key)]
            if new:
                at = np.concatenate([np.arange(starts[i] + 1, starts[i] + lengths[i]) for i in new])
                yield rows(s[at], np.repeat(m[starts[new]], lengths[new] - 1), m[at])
        if len(shard) > HELD_ROWS:
            m = c[np.concatenate([[True], c[1:] != c[:-1]])]
            if len(m) > 1:
                yield rows(np.full(len(m) - 1, shard[0]), np.full(len(m) - 1, m[0]), m[1:])
            flowing = (int(shard[0]), int(m[0]), int(m[-1]))
            shard, c = shard[:0], c[:0]


def _with_end(batches: Iterable) -> Iterator:
    yield from batches
    yield None


def _points(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for t in batch.column(0).to_pylist() if len(s := shingle_set(t, n))]
            classes = [_class_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.binary()), pa.array([_short(x) for x in classes], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([count_vector(s).tobytes() for s in sets], pa.binary())],
                ["cls", "c", "n", "vec"],
            )

    return run


def _sets(n: int):
    """(class, short class, hashed set), each class once per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                hashes = shingle_set(t, n)
                if len(hashes) and (cls := _class_of(hashes)) not in seen:
                    seen.add(cls)
                    out.append((cls, hashes.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([_short(x) for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["cls", "c", "set"])

    return run


def _bounded(num: int, den: int):
    """Of pairs with both points, those that sizes and count vectors allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for n, m, u, v in zip(*(batch.column(k).to_pylist() for k in ("n_a", "n_b", "vec_a", "vec_b")), strict=True):
                least = needed_overlap(n, m, num, den)
                width = min(dimensions(n), dimensions(m))
                fits.append(least <= min(n, m) and int(np.minimum(folded(u, n, width), folded(v, m, width)).sum(dtype=np.int64)) >= least)
            yield batch.select(["x", "y"]).filter(pa.array(fits, pa.bool_()))

    return run


def _verified(num: int, den: int):
    """Of pairs with both sets, those that link, with their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "cls_a", "cls_b", "set_a", "set_b")), strict=True):
                sa, sb = row[4:]
                both = np.concatenate([np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)])
                both.sort(kind="stable")
                if int((both[1:] == both[:-1]).sum()) >= needed_overlap(len(sa) // 8, len(sb) // 8, num, den):
                    out.append(row[:4])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["x", "y", "a", "b"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of edges (a, b) between numbered nodes, the best first: the places of those that make a spanning forest of the best ones."""
    parent = np.arange(max(a.max(initial=-1), b.max(initial=-1)) + 1)
    at, chosen = np.arange(len(a)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    while len(a):
        best = np.full(len(parent), len(a))
        np.minimum.at(best, a, np.arange(len(a)))
        np.minimum.at(best, b, np.arange(len(b)))
        for k in np.unique(best[best < len(a)]).tolist():
            x, y = root(int(a[k])), root(int(b[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                chosen.append(int(at[k]))
        roots = np.array([root(x) for x in range(len(parent))])
        a, b = roots[a], roots[b]
        apart = a != b
        a, b, at = a[apart], b[apart], at[apart]
    return np.array(chosen, np.int64)


def block_pairs(c: np.ndarray, n: np.ndarray, vec: list[bytes], label: list[bytes], part: np.ndarray, num: int, den: int, sparse: bool) -> np.ndarray:
    """Of the members of a block, or of part 0 and part 1, the pairs (x, y) in different components that the trees allow, x < y; sparse: a forest of them."""
    none = np.empty((0, 2), np.int64)
    code: dict[bytes, int] = {}
    labels = np.array([code.setdefault(x, len(code)) for x in label])
    if len(code) < 2:
        return none
    width = min(map(dimensions, n.tolist()))
    points = np.stack([folded(v, k, width) for v, k in zip(vec, n.tolist(), strict=True)])
    left, right = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    tree = CountTree(points[left], n[left], labels[left])
    other, right = (CountTree(points[right], n[right], labels[right]), right) if len(right) else (tree, left)
    found = list(tree.join(other, num, den))
    if not found:
        return none
    i, j, bound = left[np.concatenate([f[0] for f in found])], right[np.concatenate([f[1] for f in found])], np.concatenate([f[2] for f in found])
    x, y = np.minimum(c[i], c[j]), np.maximum(c[i], c[j])
    if sparse:
        order = np.lexsort((y, x, -(bound / (n[i] + n[j] - bound))))
        order = order[forest(labels[i][order], labels[j][order])]
        x, y = x[order], y[order]
    return np.unique(np.stack([x, y], axis=1), axis=0)


def _tree_pairs(num: int, den: int, sparse: bool):
    """block_pairs of members sorted by (shard, i, j): rows with part 0 are block i, those with part 1 block j; where i = j there is part 0 only.

    sparse: with the shard, since a pair that fails leaves it open; else shard is null and pairs of several shards are there once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            if batch is not None and not batch.num_rows:
                continue
            rest += [batch] if batch is not None else []
            if not rest:
                continue
            rows = pa.Table.from_batches(rest)
            keys = np.stack([rows.column(k).to_numpy() for k in ("shard", "i", "j")], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            upto = len(rows) if batch is None else int(starts[-1])
            now, rest = rows.slice(0, upto), rows.slice(upto).to_batches()
            c, n, part = (now.column(k).to_numpy() for k in ("c", "n", "part"))
            vec, label = now.column("vec").to_pylist(), now.column("label").to_pylist()
            ends = [*starts[1:].tolist(), len(rows)]
            found = [block_pairs(c[s:e], n[s:e], vec[s:e], label[s:e], part[s:e], num, den, sparse) for s, e in zip(starts.tolist(), ends, strict=True) if e <= upto]
            names = np.repeat(keys[starts[: len(found)], 0], [len(f) for f in found])
            pairs = np.concatenate([np.empty((0, 2), np.int64), *found])
            if not sparse:
                pairs = np.unique(pairs, axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(names) if sparse else pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["shard", "x", "y"])

    return run


def _semi(frame: DataFrame, ids: DataFrame, how: str, col: str) -> DataFrame:
    """Semi or anti join on one column; the ids are sent whole only if they are few."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return frame.join(ids, frame[col].eqNullSafe(ids["__key"]), how)


def _sides(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pairs (x, y) of short classes with columns of both."""

    def side(name: str, key: str) -> DataFrame:
        return sets.select(F.col("c").alias(key), *[F.col(k).alias(f"{k}_{name}") for k in columns])

    return pairs.join(side("b", "y"), "y").join(side("a", "x"), "x")


def _stars(met: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of the least member of a shard and another one, each once, if their points allow a link."""
    stars = met.select(F.col("head").alias("x"), F.col("c").alias("y")).distinct()
    return _sides(stars, points, ("n", "vec")).select("x", "y", "n_a", "n_b", "vec_a", "vec_b").mapInArrow(_bounded(num, den), "x long, y long")


def _links(pairs: DataFrame, keys: DataFrame, source: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of short classes that pass verification, with the whole classes (a, b), each once. Only their sets are made and moved."""
    spark = pairs.sparkSession
    asked = stored(spark, pairs.select(F.col("x").alias("__key")).union(pairs.select("y")).distinct(), "asked")
    ids = stored(spark, _semi(keys, asked, "left_semi", "c").select("__key").distinct(), "ids")
    sets = _semi(source, ids, "left_semi", "id").select("text").mapInArrow(_sets(n), "cls binary, c long, set binary")
    # dealt by what they are joined by, so that to have each once takes no other exchange
    sets = _semi(sets, asked, "left_semi", "c").repartition("c").dropDuplicates(["c", "cls"])
    links = stored(spark, _sides(pairs, sets, ("cls", "set")).mapInArrow(_verified(num, den), "x long, y long, a binary, b binary").distinct(), "links")
    dropped(asked, ids)
    return links


def _members(met: DataFrame, points: DataFrame, labels: DataFrame) -> DataFrame:
    """(shard, c, n, vec, label) of the shards whose members are in different components; those of two members have had their star."""
    light = points.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("c", "n", "vec", F.coalesce("label", "cls").alias("label"))
    members = met.select("shard", "c").union(met.select("shard", F.col("head").alias("c")).distinct()).join(light.select("c", "label"), "c")
    apart = members.groupBy("shard").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("held")).where("lo <> hi and held > 2")
    return members.drop("label").join(apart.select("shard", "held"), "shard").join(light, "c")


def _blocks(members: DataFrame) -> DataFrame:
    """Members dealt into blocks of about BLOCK by a hash, each block with each other one of its shard: keys (shard, i, j) and the part."""
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    grid = members.withColumn("block", F.pmod(F.xxhash64("c"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    grid = grid.select("shard", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).cast("int").alias("part"), "c", "n", "vec", "label")
    return grid.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles and component_id, the least id that links reach from it.

    Links join sets whose Jaccard similarity is threshold[0] / threshold[1] or more. What is stored on the way is removed,
    but for two tables that the result reads.
    """
    spark, (num, den) = docs.sparkSession, threshold
    shared_dir(spark)
    source = docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    prints = stored(spark, source.mapInArrow(_fingerprints(shingle_words), f"id {id_type}, n long, cls binary"), "prints")
    classes = prints.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"))

    spread = source.select("text").mapInArrow(_sharded(shingle_words, num, den), "shard long, c long")
    met = stored(spark, spread.repartition("shard").sortWithinPartitions("shard", "c").mapInArrow(_meetings, "shard long, head long, c long"), "met")
    wanted = met.select("c").union(met.select("head")).distinct()
    short = F.conv(F.hex(F.substring("cls", 1, 8)), 16, -10).cast("long")
    keys = stored(spark, classes.withColumn("c", short).join(wanted, "c", "left_semi").select("c", F.col("least").alias("__key")), "keys")
    points = _semi(source, keys.select("__key").distinct(), "left_semi", "id").select("text").mapInArrow(_points(shingle_words), "cls binary, c long, n long, vec binary")
    points = stored(spark, points.dropDuplicates(["cls"]), "points")

    labels, still = connected(spark, spark.createDataFrame([], "a binary, b binary")), met
    for step in ("stars", "forests", "rest"):
        if step == "stars":
            found = stored(spark, _stars(met, points, num, den), "found")
        else:
            found = stored(spark, _blocks(_members(still, points, labels)).mapInArrow(_tree_pairs(num, den, step == "forests"), "shard long, x long, y long"), "found")
        pairs = stored(spark, found.select("x", "y").distinct(), "pairs")
        links = _links(pairs, keys, source, shingle_words, num, den)
        if links.limit(1).count():
            # what a component is so far, as edges of a star
            older, labels = labels, connected(spark, labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(links.select("a", "b")))
            dropped(older)
        if step == "forests":
            failed = pairs.join(links.select("x", "y"), ["x", "y"], "left_anti")
            open_ = stored(spark, found.join(failed, ["x", "y"]).select(F.col("shard").alias("__key")).distinct(), "open")
            still = stored(spark, _semi(met, open_, "left_semi", "shard"), "still")
            left = open_.limit(1).count()
            dropped(open_)
        dropped(found, pairs, links)
        if step == "forests" and not left:
            break
    dropped(met, still, points, keys)

    joined = classes.join(labels.withColumnRenamed("node", "cls"), "cls")
    lowest = joined.groupBy("label").agg(F.min("least").alias("low"))
    low = joined.select("cls", "label").join(lowest, "label").select("cls", "low")
    final = classes.join(low, "cls", "left").select("cls", F.coalesce("low", "least").alias("component_id"))
    out = prints.join(final, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle_words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the document with the least id, with all its columns.

    An id names a document: of rows that repeat an id the first by their columns' order stays. Rows without an id stay.
    """
    spark = docs.sparkSession
    found = stored(spark, near_duplicates(docs, shingle_words, threshold, id_col, text), "components")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__key")).distinct()
    kept = _semi(docs, gone, "left_anti", id_col)
    again = found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__key")).count().where("count > 1").select("__key")
    again = stored(spark, again, "repeated")
    if not again.limit(1).count():
        return kept
    row = F.col("__row")
    order = [row[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rank = F.row_number().over(Window.partitionBy(row[id_col]).orderBy(*order))
    once = _semi(kept, again, "left_semi", id_col).select(F.struct("*").alias("__row")).withColumn("__rank", rank).where("__rank = 1").select("__row.*")
    return _semi(kept, again, "left_anti", id_col).unionByName(once)
