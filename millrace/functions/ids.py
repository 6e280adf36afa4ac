"""Feature ids: unsigned 64-bit numbers kept with the same bits in a bigint."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.common import ColumnLike, col

#: Digits of the largest unsigned 64-bit number, as text.
MAX_UNSIGNED = "18446744073709551615"


def hex16(x: ColumnLike) -> Column:
    """16 hex digits; their text order is the unsigned order of the ids."""
    return F.lpad(F.hex(col(x)), 16, "0")


def reversed_hex(x: ColumnLike) -> Column:
    """The digits of the nibble-reversed id; sorts as the reversed id does, unsigned. Null gives null."""
    return F.reverse(hex16(x))


def reverse_id(x: ColumnLike) -> Column:
    """The id with its 16 hex digits in reverse order; applied twice it gives the id back. Null gives null."""
    return F.conv(reversed_hex(x), 16, -10).cast("bigint")


def encode_group(x: ColumnLike, group: ColumnLike, bits: int) -> Column:
    """The group in the low bits, the id above it; the id's top bits are lost. A group that needs more bits is an error."""
    g = col(group).cast("bigint")
    inside = g.between(0, (1 << bits) - 1) | g.isNull()
    return F.shiftleft(col(x).cast("bigint"), bits).bitwiseOR(F.when(inside, g).otherwise(F.raise_error(F.lit(f"group needs more than {bits} bits")).cast("bigint")))


def decode_group(x: ColumnLike, bits: int) -> Column:
    """The group in the low bits; right for ids that look negative too."""
    return col(x).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def hash_mod(x: ColumnLike, buckets: int) -> Column:
    """The id, taken as unsigned, modulo buckets (the hashing trick)."""
    if buckets < 1:
        raise ValueError("buckets must be positive")
    high, low = F.shiftrightunsigned(col(x), 32), col(x).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    if buckets <= 1 << 30:
        return F.pmod(F.pmod(high, F.lit(buckets)) * F.lit((1 << 32) % buckets) + F.pmod(low, F.lit(buckets)), F.lit(buckets)).cast("bigint")
    wide = unsigned(x)
    return F.conv((wide % F.lit(str(buckets)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 10, -10).cast("bigint")


def unsigned(x: ColumnLike) -> Column:
    """The id as an exact decimal(20,0)."""
    return F.conv(F.hex(col(x)), 16, 10).cast("decimal(20,0)")


def from_digits(text: ColumnLike) -> Column:
    """The bigint with the bits of an unsigned id given as decimal digits."""
    return F.conv(col(text), 10, -10).cast("bigint")


def token_id(token: ColumnLike, group: ColumnLike, bits: int = 12) -> Column:
    """An id for a text token: 48 bits of its md5 above the group. Any SQL engine can compute it, and it can't overflow for 12 bits or fewer."""
    return F.shiftleft(F.conv(F.substring(F.md5(col(token)), 1, 12), 16, 10).cast("bigint"), bits).bitwiseOR(col(group).cast("bigint"))


def ordered(x: ColumnLike) -> Column:
    """A bigint whose signed order is the unsigned order of the ids."""
    return col(x).bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))


def edges_below(edges: list[int], key: Column) -> Column:
    """How many of the ascending unsigned edges are at most the id of which key is the ordered form. The id's leading bits lead to the few edges that share them, which are then compared."""
    bits = min(16, max(0, len(edges) - 1).bit_length())
    starts = np.searchsorted(np.array(edges, np.uint64), np.array([b << (64 - bits) for b in range(1 << bits)], np.uint64)).tolist() + [len(edges)] if bits else [0, len(edges)]
    all_ = F.lit(np.array([e - (1 << 63) for e in edges], np.int64))
    at = F.shiftrightunsigned(ordered(key), 64 - bits).cast("int") if bits else F.lit(0)
    of = F.lit(np.array(starts, np.int32))
    first, past = F.get(of, at), F.get(of, at + 1)
    return first + F.size(F.filter(F.slice(all_, first + 1, past - first), lambda e: e <= key))


@dataclass(frozen=True)
class Range:
    """The half-open range of ids from begin to before end, of unsigned 64-bit numbers."""

    begin: int
    end: int

    @property
    def valid(self) -> bool:
        return 0 <= self.begin < self.end

    @property
    def size(self) -> int:
        return self.end - self.begin

    def has(self, x: int) -> bool:
        return self.begin <= x < self.end

    def holds(self, x: ColumnLike) -> Column:
        """Whether the range has the id in a column."""
        if not self.valid:
            return F.lit(False)
        low, high = (F.lit(e - (1 << 63)).cast("bigint") for e in (self.begin, min(self.end, 1 << 64) - 1))
        return ordered(x).between(low, high)

    def segment(self, part: int, parts: int) -> Range:
        return Range(*segment(self.begin, self.end, part, parts))

    def __add__(self, n: int) -> Range:
        return Range(self.begin + n, self.end + n)

    def __sub__(self, n: int) -> Range:
        return Range(self.begin - n, self.end - n)

    def __mul__(self, n: int) -> Range:
        return Range(self.begin * n, self.end * n)


#: All ids but the last.
ALL = Range(0, (1 << 64) - 1)


def segment(begin: int, end: int, part: int, parts: int) -> tuple[int, int]:
    """Part of parts equal pieces of the half-open range; double arithmetic, the last piece takes the exact end."""
    if not 0 <= part < parts or end < begin:
        raise ValueError("no such segment")
    step = (end - begin) / parts
    at = lambda i: begin + int(step * i)
    return at(part), end if part == parts - 1 else at(part + 1)
