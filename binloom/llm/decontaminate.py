"""Benchmark decontamination: passages of a benchmark found in documents in spite of edits.

Texts are compared in lower case with single spaces. A document holds an item if some part of it is
within max_edit_rate edits per character of the item, wherever the edits fall. Places are found by pieces, which lose
none of these, and then by walks, which reach a target recall:

* an item of L characters that may take k edits is cut into L // q pieces of q characters. An edit
  spoils one piece at most, so need = L // q - k pieces stand unchanged in any match;
* insertions and deletions, at most k together, shift those pieces against each other by no more than
  k. Places where need pieces lie on diagonals within k of each other are candidates, at every size of
  item and every place in a word; q is the largest that leaves LEAST_PIECES pieces, if any does;
* each edit spoils at most GRAM of the item's strings of GRAM characters; a candidate without the
  others, counted with and without repeats, is left;
* at what is left, windows of the item's length are embedded by CGK walks: a walk copies a character a step and moves
  on, or stays, by a random bit of step and character, so that texts within few edits soon walk in step again and
  differ in few places. Bit sampling hashes some places of a walk, several times a walk; a candidate of which no window
  shares a hash with the item is left. Walks and tables are independent repetitions, by which the target recall is met;
* what remains is verified exactly: the least edit distance of the item to any part of the document
  around it, by bit-parallel dynamic programming.

Pieces are compared by hash, which may add candidates but loses none; walks lose what their recall lacks. Items go to the executors in
blocks of bounded size, one pass each; documents are never shuffled, long ones are read in parts that
overlap by more than a match.

Defined results: null, empty and wordless documents or items match nothing; an item of fewer than
three words, or too short for an edit, matches whole words only; repeated rows match alike; of matches
of one item in one document the nearest is reported, ties by the first end. Tables without rows give no matches, and
without items every document stays; other columns, whatever their names, are not read by find_passages and kept by
drop_contaminated.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

ITEM_BLOCK = 5_000
#: Characters that are searched at a time.
SLICE_CHARS = 1 << 18
LONGEST_PIECE, LEAST_PIECES = 6, 4
#: Length of the strings that a candidate is counted by.
GRAM = 4
SLOT_BITS = 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Characters of walks, and windows of candidates, that are held at once.
WALK_CHARS, WINDOWS = 1 << 22, 1 << 16


@dataclass(frozen=True)
class Search:
    """Largest edits per character of an item; CGK walks of a window, hash tables of a walk, and places that a table samples."""

    max_edit_rate: float = 0.15
    walks: int = 12
    tables: int = 48
    places: int = 4


def _scattered(x: np.ndarray) -> np.ndarray:
    """64 mixed bits of each number, always the same."""
    x = (x + np.uint64(1)) * FACTOR
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walks:
    """CGK embeddings of windows, sampled: equal texts get equal hashes, texts within few edits some equal ones."""

    def __init__(self, search: Search) -> None:
        self.walks, self.tables, self.places = search.walks, search.tables, search.places
        draws = _scattered(np.arange(search.walks * search.tables * search.places, dtype=np.uint64) + np.uint64(1 << 40))
        #: where a table samples, as a share of a walk
        self.shares = ((draws >> np.uint64(11)).astype(np.float64) / 2.0**53).reshape(search.walks, -1)

    def batches(self, lengths: list[int]) -> Iterator[list[int]]:
        """Places of windows held against items of these lengths, in lists whose walks and samples are WALK_CHARS at most."""
        return _within([max(2 * n, self.tables * self.places) for n in lengths], WALK_CHARS // self.walks)

    def hashes(self, windows: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """One row of walks x tables hashes per window of code points; lengths are those of the items that they are held against.

        A walk has two steps a character, which takes it about to the end of the window; beyond the end it reads zeros.
        """
        longest, steps = int(lengths.max()), 2 * int(lengths.max())
        text = np.zeros((len(windows), longest + 1), np.uint64)
        for row, w in enumerate(windows):
            text[row, : len(w)] = w[:longest]
        text, first = text.ravel(), np.arange(len(windows))[:, None] * (longest + 1)
        at = np.broadcast_to(first, (len(windows), self.walks)).copy()
        coins = _scattered(np.arange(2 * steps * self.walks, dtype=np.uint64)).reshape(steps, 2, self.walks)
        walked = np.empty((steps, len(windows), self.walks), np.uint32)
        for k in range(steps):
            walked[k] = c = text[at]
            at += ((c * (coins[k, 0] | np.uint64(1)) + coins[k, 1]) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, first + longest, out=at)
        step = (self.shares[None] * (2 * lengths)[:, None, None]).astype(np.int64)
        drawn = walked[step, np.arange(len(windows))[:, None, None], np.arange(self.walks)[None, :, None]].reshape(len(windows), -1, self.places).astype(np.uint64)
        out = np.zeros(drawn.shape[:2], np.uint64)
        for k in range(self.places):
            out = (out + drawn[:, :, k] + np.uint64(1)) * FACTOR
        return out


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def normal(found: list[bytes]) -> str:
    return b" ".join(found).decode("utf-8", "surrogatepass")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slots(points: np.ndarray, wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each wanted length, rising: the slots of all strings of that length."""
    value = code = (points.astype(np.uint64) + np.uint64(1)) * FACTOR
    for q in range(1, wanted[-1] + 1):
        if q > len(points):
            return
        if q > 1:
            value = value[:-1] * FACTOR + code[q - 1 :]
        if q in wanted:
            yield q, (value >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def piece_length(length: int, most: int) -> int:
    """The longest pieces of which LEAST_PIECES survive `most` edits; else those of which most survive."""
    if not most:
        return min(length, LONGEST_PIECE)
    return max(range(1, min(length, LONGEST_PIECE) + 1), key=lambda q: (min(length // q - most, LEAST_PIECES), q))


def best_match(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the part of text with the least edit distance to pattern, if at most `most`; ties by first end, then longest part."""

    def scan(pattern: str, text: str) -> list[int]:
        """Least distance of pattern to a part that ends after each character, by Myers' bit vectors."""
        at: dict[str, int] = {}
        for i, c in enumerate(pattern):
            at[c] = at.get(c, 0) | 1 << i
        full, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
        up, down, score, out = full, 0, len(pattern), []
        for c in text:
            eq = at.get(c, 0)
            x = eq | down
            d = (((eq & up) + up) ^ up) | eq
            ph = down | ~(d | up) & full
            mh = up & d
            score += bool(ph & top) - bool(mh & top)
            ph, mh = ph << 1 & full, mh << 1 & full
            up, down = mh | ~(x | ph) & full, ph & x
            out.append(score)
        return out

    if not pattern or not text:
        return None
    ends = scan(pattern, text)
    distance = min(ends)
    if distance > most:
        return None
    end = ends.index(distance) + 1
    head = text[max(0, end - len(pattern) - distance) : end]
    starts = scan(pattern[::-1], head[::-1])
    return distance, end - max(i + 1 for i, d in enumerate(starts) if d == distance), end


def best_words(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """Like best_match, of parts that begin and end with whole words of text."""
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == " ")]
    ends = [*(i for i, c in enumerate(text) if c == " "), len(text)]
    found = []
    for a in starts:
        for b in ends[bisect_left(ends, max(a + 1, a + len(pattern) - most)) : bisect_right(ends, a + len(pattern) + most)]:
            row = list(range(b - a + 1))
            for i, x in enumerate(pattern, 1):
                new = [i]
                for j, y in enumerate(text[a:b], 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            if row[-1] <= most:
                found.append((row[-1], b, a))
    if not found:
        return None
    distance, end, start = min(found)
    return distance, start, end


class Index:
    """A block of items and the slots of their pieces."""

    def __init__(self, items: list[tuple[object, str]], search: Search) -> None:
        kept = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _ in kept]
        self.texts = [normal(w) for _, w in kept]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.minimum(np.floor(self.lengths * search.max_edit_rate).astype(np.int64), self.lengths - 1)
        self.whole = np.array([len(w) < 3 for _, w in kept], bool) | (self.most == 0)
        sizes = [piece_length(int(n), int(k)) for n, k in zip(self.lengths, self.most, strict=True)]
        self.need = np.array([int(n) // q - int(k) if k else 1 for n, k, q in zip(self.lengths, self.most, sizes, strict=True)], np.int64)
        self.grams: dict[int, set[str]] = {}
        self.walks, self.walked = Walks(search), {}
        #: More than any match or shift of pieces reaches.
        self.reach = int((self.lengths + self.most).max()) + 1 if kept else 0
        self.sizes = sorted(set(sizes))
        self.pieces = {q: self._pieces([k for k, size in enumerate(sizes) if size == q], q) for q in self.sizes}

    def _pieces(self, of: list[int], q: int):
        """First row and number of rows by slot; item and offset by row."""
        slots = [next(s for size, s in _slots(_points(self.texts[k]), [q]) if size == q)[::q] for k in of]
        slot = np.concatenate(slots)
        order = np.argsort(slot, kind="stable")
        item = np.concatenate([np.full(len(s), k) for s, k in zip(slots, of, strict=True)])[order]
        offset = np.concatenate([np.arange(len(s)) * q for s in slots])[order]
        count = np.bincount(slot, minlength=1 << SLOT_BITS)
        return (np.cumsum(count) - count).astype(np.int32), count.astype(np.int32), item, offset

    def _shares_grams(self, item: int, text: str) -> bool:
        """Whether some part of text, as long as a match can be, has as many strings of the item as a match must leave."""
        least = int(self.lengths[item]) - GRAM + 1 - GRAM * int(self.most[item])
        if least <= 0:
            return True
        if (grams := self.grams.get(item)) is None:
            pattern = self.texts[item]
            grams = self.grams[item] = {pattern[i : i + GRAM] for i in range(len(pattern) - GRAM + 1)}
        at = [i for i in range(len(text) - GRAM + 1) if text[i : i + GRAM] in grams]
        if len({text[i : i + GRAM] for i in at}) < len(grams) - GRAM * int(self.most[item]):
            return False
        most = int(self.lengths[item] + self.most[item]) - GRAM
        return any(b - a <= most for a, b in zip(at, at[least - 1 :], strict=False))

    def _walks_meet(self, found: list[tuple[int, str, int]]) -> np.ndarray:
        """Of (item, text, how far windows may begin in it), whether some window of the item's length shares a hash with the item.

        Windows begin at words, at the first place and at the place where the item begins if nothing was put in or left out.
        """
        met = np.zeros(len(found), bool)
        new = sorted({item for item, _, _ in found} - self.walked.keys())
        for some in self.walks.batches(self.lengths[new].tolist()):
            of = [new[k] for k in some]
            for item, row in zip(of, self.walks.hashes([_points(self.texts[k]) for k in of], self.lengths[of]), strict=True):
                self.walked[item] = row
        windows = []

        def walk() -> None:
            for some in self.walks.batches([int(self.lengths[item]) for _, item, _ in windows]):
                of = [windows[k] for k in some]
                hashes = self.walks.hashes([w for _, _, w in of], self.lengths[[item for _, item, _ in of]])
                same = (hashes == np.stack([self.walked[item] for _, item, _ in of])).any(axis=1)
                met[[k for (k, _, _), s in zip(of, same.tolist(), strict=True) if s]] = True
            windows.clear()

        for k, (item, text, upto) in enumerate(found):
            points, length = _points(text), int(self.lengths[item])
            for b in np.unique([0, min(int(self.most[item]), upto), upto, *(np.flatnonzero(points[:upto] == 32) + 1)]).tolist():
                windows.append((k, item, points[b : b + length]))
                if len(windows) >= WINDOWS:
                    walk()
        walk()
        return met

    def candidates(self, parts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(part, item, first, last diagonal): all matches' pieces lie on one of those diagonals or at most `most` above."""
        length = np.array([len(p) for p in parts], np.int64)
        first = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
        # between parts lies more than diagonals can be apart that are near each other
        base = first + np.arange(len(parts)) * 2 * self.reach + self.reach
        span = int(base[-1] + length[-1]) + self.reach
        part_of = np.repeat(np.arange(len(parts)), length + 1)
        keys = []
        for q, slot in _slots(_points("\n".join(parts)), self.sizes):
            start, number, item, offset = self.pieces[q]
            count = number[slot]
            where = np.flatnonzero(count)
            if not len(where):
                continue
            count, lo = count[where].astype(np.int64), start[slot[where]].astype(np.int64)
            row = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
            place = where + (base - first)[part_of[where]]
            keys.append(item[row] * span + np.repeat(place, count) - offset[row])
        if not keys:
            return
        key = np.sort(np.concatenate(keys))
        item = key // span
        last = np.arange(len(key)) + self.need[item] - 1
        fits = last < len(key)
        last = np.minimum(last, len(key) - 1)
        # keys of other items are at least 2 * reach away
        good = key[fits & (key[last] - key <= self.most[item])]
        if not len(good):
            return
        item = good // span
        apart = np.flatnonzero(good[1:] - good[:-1] > self.most[item[1:]]) + 1
        begin, end = np.concatenate([[0], apart]), np.concatenate([apart, [len(good)]]) - 1
        low, high, item = good[begin] % span, good[end] % span, item[begin]
        part = np.maximum(np.searchsorted(base - self.reach, low, "right") - 1, 0)
        yield from zip(part.tolist(), item.tolist(), (low - base[part]).tolist(), (high - base[part]).tolist(), strict=True)

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document's place, item's place, start, end, distance), one for each document and item that match."""
        if not self.ids:
            return
        lines = [normal(words_of(t)) for t in texts]
        parts = [(d, a) for d, line in enumerate(lines) for a in range(0, max(len(line) - self.reach, 1), SLICE_CHARS) if line]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for some in _slices(parts, [min(len(lines[d]) - a, SLICE_CHARS + self.reach) for d, a in parts]):
            left = []
            for part, item, low, high in self.candidates([lines[d][a : a + SLICE_CHARS + self.reach] for d, a in some]):
                d, a = some[part]
                line, length, most = lines[d], int(self.lengths[item]), int(self.most[item])
                begin, end = max(0, a + low - most), min(len(line), a + high + length + most)
                if self.whole[item]:
                    # out to whole words, with one more character than a word within reach has
                    begin = line.rfind(" ", 0, begin + 1) + 1
                    end = len(line) if (at := line.find(" ", end)) < 0 else at
                elif not self._shares_grams(item, line[begin:end]):
                    continue
                left.append((d, item, begin, end, min(max(0, a + high + most - begin), end - begin)))
            met = self._walks_meet([(item, lines[d][begin:end], upto) for d, item, begin, end, upto in left])
            for k in np.flatnonzero(met).tolist():
                d, item, begin, end, _ = left[k]
                m = (best_words if self.whole[item] else best_match)(self.texts[item], lines[d][begin:end], int(self.most[item]))
                if m is not None:
                    m = (m[0], m[2] + begin, m[1] + begin)
                    best[d, item] = min(m, best.get((d, item), m))
        for (d, item), (distance, end, start) in sorted(best.items()):
            yield d, item, start, end, distance


def _slices(rows: list, sizes: list[int]) -> Iterator[list]:
    """Rows in turn, in lists of SLICE_CHARS or one row more."""
    begin, size = 0, 0
    for k, n in enumerate(sizes):
        size += n
        if size >= SLICE_CHARS:
            yield rows[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(rows):
        yield rows[begin:]


def _within(lengths: list[int], most: int) -> Iterator[list[int]]:
    """Places of lengths, the longest first, in lists whose number times their longest is `most` at most, or of one."""
    order, begin = sorted(range(len(lengths)), key=lambda k: -lengths[k]), 0
    while begin < len(order):
        n = max(1, most // max(1, lengths[order[begin]]))
        yield order[begin : begin + n]
        begin += n


def _blocks(items: DataFrame, id_col: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks that a task can hold."""
    items = items.select(F.col(id_col).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    n = -(-items.count() // ITEM_BLOCK)
    for k in range(n):
        yield [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def find_passages(docs: DataFrame, items: DataFrame, search: Search | None = None, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(document id, item id, start, end, distance) of each item found in a document, in code points of the normalised text."""
    search = search or Search()
    source = docs.select(F.col(id_col).alias("d"), F.col(text).cast("string").alias("t"))
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"d {kinds[0]}, i {kinds[1]}, start long, end long, distance long"
    item_kind = to_arrow_type(items.schema[item_id].dataType)
    out = None
    for block in _blocks(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = Index(block, search)
            for batch in batches:
                rows = [(d, index.ids[i], s, e, x) for d, i, s, e, x in index.matches(batch.column(1).to_pylist())]
                if rows:
                    ids = batch.column(0).take(pa.array([r[0] for r in rows]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], item_kind), *[pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4)]], ["d", "i", "start", "end", "distance"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.select(F.col("d").alias(id_col), F.col("i").alias(item_id), "start", "end", "distance")


def drop_contaminated(docs: DataFrame, items: DataFrame, search: Search | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    search, place = search or Search(), docs.columns.index(text)
    for block in _blocks(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = Index(block, search)
            for batch in batches:
                bad = {d for d, *_ in index.matches(batch.column(place).to_pylist())}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_())) if bad else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs
