"""Column functions on arrays and long texts whose work grows as n log n: no append per element, no walk to a position per cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a piece of a text from which parts are cut.
CHUNK = 1024


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def scanned(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Of an array, what `add` makes of all elements so far, by doubling distances: log n passes, and no append per element."""
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(values))) - 1)

    def doubled(so_far: Column, k: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(so_far, lambda x, i: F.when(i >= far, add(F.get(so_far, i - far), x)).otherwise(x))

    return F.aggregate(rounds, values, doubled)


def leading(values: Column, test: Callable[[Column], Column]) -> Column:
    """How many elements come before the first that fails a test, which none after it passes; by halving."""
    steps = F.transform(F.sequence(F.length(F.bin(F.size(values))) - 1, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(test(F.get(values, found + step - 1)), found + step).otherwise(found))


def chunks(text: Column) -> Column:
    """A text in pieces of CHUNK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: str | Column, start: Column, end: Column) -> Column:
    """Code points start to end of the text whose chunks these are: what is before them isn't gone through again for every cut."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.array_join(F.slice(pieces, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(held, start - first * CHUNK + 1, end - start)).otherwise(F.lit(""))
