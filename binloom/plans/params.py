"""Parameters of blocking and of staged intersection, checked when made."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

#: Modulus of the permutation family; hashes of shingles have 28 bits, so products stay under 2**60.
MODULUS = 2**31 - 1
#: A prime above 2**32; bins of a band are a bijection of residues whatever the prime.
BIN_PRIME = 4294967311


@dataclass(frozen=True)
class LinkageParams:
    """bins_per_band bins for each of `bands` bands of `per_band` permutations."""

    bins_per_band: int = 1024
    per_band: int = 2
    bands: int = 8
    shingle: int = 4
    seed: int = 1

    def __post_init__(self) -> None:
        if min(self.bins_per_band, self.per_band, self.bands, self.shingle) < 1:
            raise ValueError("bins, permutations, bands and shingle length are 1 or more")
        if self.bins_per_band > 2**31:
            raise ValueError("bins_per_band is at most 2**31")

    @classmethod
    def for_rows(cls, n: int, bands: int = 8, per_bin: int = 16, **more) -> LinkageParams:
        """Bins in number to the larger side's rows, so that a bin keeps about per_bin of them and comparisons grow with the rows, not with their square."""
        return cls(bins_per_band=min(2**31, max(16, -(-n // per_bin))), bands=bands, **more)

    @property
    def permutations(self) -> int:
        return self.per_band * self.bands

    @cached_property
    def coefficients(self) -> list[tuple[int, int]]:
        """(a, b) of each permutation (a * h + b) % MODULUS; a longer family starts with a shorter one."""
        state, out = self.seed * 2654435761 % MODULUS or 1, []
        for _ in range(self.permutations):
            state = a = state * 48271 % MODULUS
            state = b = state * 48271 % MODULUS
            out.append((a, b))
        return out


@dataclass(frozen=True)
class SetParams:
    """Staged intersection of integers of `bits` bits in `blocks` ranges of values."""

    blocks: int = 8
    bits: int = 16

    def __post_init__(self) -> None:
        if self.blocks < 1 or not 1 <= self.bits <= 32:
            raise ValueError("blocks is 1 or more, bits 1 to 32")

    @classmethod
    def for_size(cls, n: int, bits: int = 32, per_block: int = 100_000) -> SetParams:
        """Blocks in number to the larger side's values, so that a block stays what one task can hold."""
        return cls(max(1, -(-n // per_block)), bits)

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1

    @property
    def width(self) -> int:
        return (self.mask - 1) // self.blocks + 1

    @property
    def slots(self) -> int:
        return 2 * self.blocks
