"""Number functions: range blocks, bits, shares, gates of a permutation network."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from binloom.plans.params import BIN_PRIME, SetParams

#: Rounds of the permutation of integers; each part is changed twice.
FEISTEL_ROUNDS = 4


def block_of(v: Column, p: SetParams) -> Column:
    """Range block of a value; the largest value stays in the last block."""
    return F.least(F.floor(v / p.width), F.lit(p.blocks - 1)).cast("long")


def affine_bin(v: Column, bins: int, start: int = 0) -> Column:
    """A bin in [start, start + bins), without 64-bit overflow."""
    return F.pmod(F.pmod(v, F.lit(bins)) * F.lit(BIN_PRIME % bins), F.lit(bins)) + F.lit(start)


def permuted(v: Column, bits: int, seed: int = 1) -> Column:
    """A keyed permutation of the integers of `bits` bits, 0 to 2**bits - 1: a Feistel network on two parts of about equal width.

    Each round adds to one part what the MD5 of seed, round and the other part gives, so that every round, and all of
    them, can be undone; any width is met exactly. Different integers stay different, whatever there are of them.
    """
    if not 2 <= bits <= 62:
        raise ValueError("bits is 2 to 62")
    widths = [bits // 2, bits - bits // 2]
    parts = [F.call_function("shiftright", v, F.lit(widths[1])), v.bitwiseAND(F.lit((1 << widths[1]) - 1))]
    for k in range(FEISTEL_ROUNDS):
        digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{k}"), parts[1 - k % 2].cast("string")).cast("binary"))
        own = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        parts[k % 2] = parts[k % 2].bitwiseXOR(own.bitwiseAND(F.lit((1 << widths[k % 2]) - 1)))
    return F.call_function("shiftleft", parts[0], F.lit(widths[1])).bitwiseOR(parts[1])


def to_bits(v: Column, bits: int = 32) -> Column:
    """Bits, the lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftright", v, i).bitwiseAND(F.lit(1)))


def from_bits(bits: Column) -> Column:
    numbered = F.transform(bits, lambda b, i: F.call_function("shiftleft", b.cast("long"), i))
    return F.aggregate(numbered, F.lit(0).cast("long"), lambda a, x: a + x)


def xor_shares(v: Column, mask: Column) -> tuple[Column, Column]:
    """Two shares whose exclusive or is v. No privacy is claimed: mask is whatever the caller gives."""
    return mask, v.bitwiseXOR(mask)


def swap_gates(n: Column) -> Column:
    """Conditional swaps of a recursive permutation network on n wires: the sum of ceil(log2(i)) for i up to n."""
    return F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(0).cast("long"), lambda total, i: total + F.ceil(F.log2(i.cast("double"))))
