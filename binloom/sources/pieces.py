"""Large files read in parallel by byte ranges: one JSON array, or numbers of one line.

Neither has line breaks to cut at, so a file is cut at fixed offsets and each piece finds the borders of elements itself.
A first pass tells of each piece, as one row, what it does to whoever reads on after it: for JSON, whether a string that is
or isn't open at its start is open at its end, how deep its brackets leave off, and how many elements begin at which depth.
The driver goes through these rows in order, so that each piece's true start is known, not guessed: a text may hold `],[`.
The second pass gives every element from the piece that it begins in, with its place in the file, as texts that Spark's
own functions take apart. A task holds one piece and the rest of its last element.

Files are opened through Arrow's file systems (local, HDFS, S3 and others by their URI).
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a piece.
PIECE = 8 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Cut:
    """The pieces of a file, or of a folder's files by name, by number."""

    def __init__(self, path: str, piece: int) -> None:
        system, at = _place(path)
        info, prefix = system.get_file_info(at), path.removesuffix(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = [info] if info.is_file else sorted((x for x in system.get_file_info(fs.FileSelector(at)) if x.is_file and x.base_name[0] not in "._"), key=lambda x: x.path)
        self.piece, self.files, self.first = piece, [(prefix + x.path, x.size) for x in files], [0]
        for _, size in self.files:
            self.first.append(self.first[-1] + -(-size // piece))

    def __len__(self) -> int:
        return self.first[-1]

    def of(self, number: int) -> tuple[str, int, int, int]:
        """File, its size, start and end of the piece."""
        k = bisect_right(self.first, number) - 1
        path, size = self.files[k]
        start = (number - self.first[k]) * self.piece
        return path, size, start, min(size, start + self.piece)


def _read(path: str, start: int, end: int) -> np.ndarray:
    system, at = _place(path)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read_at(end - start, start), np.uint8)


def _before(path: str, start: int) -> int:
    """How many backslashes stand right before an offset."""
    found = 0
    while start:
        data = _read(path, max(0, start - 1024), start)
        own = np.flatnonzero(data != 92)
        run = len(data) - 1 - int(own[-1]) if len(own) else len(data)
        found, start = found + run, start - len(data)
        if run < len(data):
            break
    return found


def marks(data: np.ndarray, backslashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes that open or close a string, places of brackets and their depths' changes, strings or not."""
    slash = np.flatnonzero(data == 92)
    escaped = np.empty(0, np.int64)
    if len(slash):
        start = np.flatnonzero(np.concatenate([[True], np.diff(slash) > 1]))
        end = np.append(start[1:], len(slash)) - 1
        run = end - start + 1 + np.where(slash[start] == 0, backslashes, 0)
        escaped = slash[end][run % 2 == 1] + 1
    if backslashes % 2 and (not len(slash) or slash[0] > 0):
        escaped = np.append(escaped, 0)
    quotes = np.flatnonzero(data == 34)
    quotes = quotes[~np.isin(quotes, escaped)]
    opens = (data == 91) | (data == 123)
    at = np.flatnonzero(opens | (data == 93) | (data == 125))
    return quotes, at, np.where(opens[at], 1, -1)


def _outside(quotes: np.ndarray, at: np.ndarray, change: np.ndarray, in_string: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brackets outside strings: places, changes and the depth before each, from 0."""
    out = (np.searchsorted(quotes, at) + in_string) % 2 == 0
    at, change = at[out], change[out]
    return at, change, np.cumsum(change) - change


def _json_effects(cut: Cut):
    """(piece, in_string, ends_in_string, depth, at, n): for both ways to begin, how it ends and how many brackets open at which relative depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for number in (k for b in batches for k in b.column(0).to_pylist()):
            path, _, start, end = cut.of(number)
            quotes, at, change = marks(_read(path, start, end), _before(path, start))
            for begun in (0, 1):
                _, own, depth = _outside(quotes, at, change, begun)
                counts = Counter(depth[own > 0].tolist())
                rows += [(number, begun, (begun + len(quotes)) % 2, int(own.sum()), d, n) for d, n in counts.items()] or [(number, begun, (begun + len(quotes)) % 2, int(own.sum()), 0, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], ["piece", "in_string", "ends", "depth", "at", "n"])

    return run


def _elements(cut: Cut, states: dict[int, tuple[int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (k for b in batches for k in b.column(0).to_pylist()):
            path, size, start, end = cut.of(number)
            in_string, depth, pos = states[number]
            more, escapes = 1 << 16, _before(path, start)
            while True:
                stop = min(size, end + more)
                data = _read(path, start, stop)
                at, change, before = _outside(*marks(data, escapes), in_string)
                before = before + depth
                first, last = at[(change > 0) & (before == 1)], at[(change < 0) & (before == 2)]
                last = last[1:] if depth >= 2 else last
                own = int(np.searchsorted(first, end - start))
                if len(last) >= own or stop == size:
                    break
                more *= 4
            own = min(own, len(last))
            raw = data.tobytes()
            values = [raw[a : b + 1] for a, b in zip(first[:own].tolist(), last[:own].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(pos, pos + own)), pa.array(values, pa.binary()).cast(pa.string())], ["pos", "value"])

    return run


def json_elements(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(pos, value): the elements, arrays or objects, of the JSON array that a file is, as JSON texts with their places from 0.

    Of a folder each file is an array, and places go on from file to file. The file is UTF-8; what stands around the
    array and between elements is not looked at. An element cut off by the file's end is left out.
    """
    cut = Cut(path, piece)
    numbers = spark.range(0, len(cut), 1, max(1, len(cut)))
    effects: dict[tuple[int, int], tuple[int, int, Counter]] = {}
    for r in numbers.mapInArrow(_json_effects(cut), "piece long, in_string long, ends long, depth long, at long, n long").collect():
        effects.setdefault((r.piece, r.in_string), (r.ends, r.depth, Counter()))[2][r["at"]] += r.n
    states, pos = {}, 0
    for number in range(len(cut)):
        if number in cut.first:
            in_string = depth = 0
        states[number] = (in_string, depth, pos)
        ends, change, opened = effects[number, in_string]
        pos, in_string, depth = pos + opened[1 - depth], ends, depth + change
    return numbers.mapInArrow(_elements(cut, states), "pos long, value string")


def _token_starts(path: str, start: int, end: int) -> np.ndarray:
    back = min(start, 1)
    gap = _SPACE[_read(path, start - back, end)]
    gap = gap if back else np.concatenate([[True], gap])
    return np.flatnonzero(gap[:-1] & ~gap[1:])


def _token_counts(cut: Cut):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = [k for b in batches for k in b.column(0).to_pylist()]
        counts = [len(_token_starts(path, start, end)) for path, _, start, end in map(cut.of, numbers)]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(counts, pa.int64())], ["piece", "n"])

    return run


def _numbers(cut: Cut, first: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (k for b in batches for k in b.column(0).to_pylist()):
            path, size, start, end = cut.of(number)
            own, more = _token_starts(path, start, end), 64
            if not len(own):
                continue
            while True:
                data = _read(path, start, stop := min(size, end + more))
                gaps = np.flatnonzero(_SPACE[data[end - start - 1 :]])
                if len(gaps) or stop == size:
                    break
                more *= 4
            upto = end - start - 1 + int(gaps[0]) if len(gaps) else len(data)
            values = np.array(data[own[0] : upto].tobytes().split()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first[number], first[number] + len(values))), pa.array(values)], ["pos", "v"])

    return run


def integers(spark: SparkSession, path: str, n: int | None = None, piece: int = PIECE) -> DataFrame:
    """(pos, v): the integers of a file or of a folder's files, parted by white space, with their places from 0; the first n if given, and then no later piece is read."""
    cut = Cut(path, piece)
    numbers = spark.range(0, len(cut), 1, max(1, len(cut)))
    first, pos = {}, 0
    for _, count in sorted(map(tuple, numbers.mapInArrow(_token_counts(cut), "piece long, n long").collect())):
        first[len(first)], pos = pos, pos + count
    wanted = len(cut) if n is None else sum(at < n for at in first.values())
    out = spark.range(0, wanted, 1, max(1, wanted)).mapInArrow(_numbers(cut, first), "pos long, v long")
    return out if n is None else out.where(out.pos < n)
