"""Packed identifiers: two bits a base, A=0 C=1 G=2 T=3, first base most significant.

All functions take and give columns and stay inside generated code or array functions.
Identifiers are longs; at 32 bases the top bit is used, so order such ones with
``unsigned_order``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def is_clean(bases: Column) -> Column:
    """All of A, C, G, T in either case, and not empty."""
    return F.length(F.translate(F.upper(bases), BASES, "")).eqNullSafe(0) & (F.length(bases) > 0)


def is_alphabet(c: Column) -> Column:
    """Whether a text begins with a letter of a read: A, C, G, T or N in either case."""
    return F.coalesce(c.rlike("^[ACGTNacgtn]"), F.lit(False))


def base_code(c: Column) -> Column:
    """0 to 3, or -1 for anything else."""
    up = F.upper(c)
    return F.when(F.length(up) == 1, F.instr(F.lit(BASES), up) - 1).otherwise(F.lit(-1))


def base_char(code: Column) -> Column:
    return F.substr(F.lit("acgt"), code.cast("int") + 1, F.lit(1))


def pack(bases: Column, length: int) -> Column:
    """Identifier of ``length`` clean bases.

    Bases become base-4 digits; ``conv`` reads digits of 16 bases at a time.
    """
    digits = F.translate(F.upper(bases), BASES, "0123")

    def part(at: int, n: int) -> Column:
        return F.conv(F.substring(digits, at, n), 4, 10).cast("long")

    if length <= 16:
        return part(1, length)
    return F.shiftleft(part(1, length - 16), 32).bitwiseOR(part(length - 15, 16))


def unpack(ident: Column, length: int) -> Column:
    """Bases of an identifier, in lower case."""
    shifts = F.array(*[F.lit(2 * p) for p in range(length - 1, -1, -1)])
    one = lambda s: base_char(F.call_function("shiftright", ident, s).bitwiseAND(3))
    return F.array_join(F.transform(shifts, one), "")


def revcomp(bases: Column) -> Column:
    """Reverse complement of a string; other characters stay."""
    return F.translate(F.reverse(bases), "ACGTacgt", "TGCAtgca")


def revcomp_id(ident: Column, length: int) -> Column:
    """Reverse complement of an identifier: bit tricks, no strings.

    Swaps neighbouring 2-bit groups at doubling distances over 64 bits, complements, and
    shifts the used bits down.
    """
    x = ident
    masks = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF))
    for by, mask in masks:
        m = F.lit(mask).cast("long")
        x = F.shiftrightunsigned(x, by).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), by))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(F.bitwise_not(x), 64 - 2 * length)


def head_of(tile: Column, step: int) -> Column:
    """First k bases of a tile."""
    return F.shiftrightunsigned(tile, 2 * step)


def tail_of(tile: Column, k: int) -> Column:
    """Last k bases of a tile."""
    return tile.bitwiseAND(F.lit((1 << (2 * k)) - 1).cast("long"))


def substitute(ident: Column, position: Column, base: Column) -> Column:
    """Identifier with the base at bit position ``position`` (0: last) replaced."""
    at = position * 2
    hole = F.bitwise_not(F.call_function("shiftleft", F.lit(3).cast("long"), at))
    return ident.bitwiseAND(hole).bitwiseOR(F.call_function("shiftleft", base.cast("long"), at))


def differences(a: Column, b: Column, length: int) -> Column:
    """(pos, from, to) where identifiers differ, right to left: from of ``a``, to of ``b``."""
    where = F.array(*[F.lit(p) for p in range(length)])

    def one(p: Column) -> Column:
        bits = lambda x: F.call_function("shiftright", x, p * 2).bitwiseAND(3).cast("int")
        return F.struct((F.lit(length - 1) - p).alias("pos"), bits(a).alias("from"), bits(b).alias("to"))

    return F.filter(F.transform(where, one), lambda e: e["from"] != e["to"])


def unsigned_order(ident: Column) -> Column:
    """Sort key of identifiers that use all 64 bits."""
    return ident.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def bytes_needed(x: Column) -> Column:
    """Bytes of the shortest unsigned form of a non-negative number, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 8)).cast("int")


def low_quality_count(quals: Column, threshold: int) -> Column:
    """Characters below the threshold: codes are compared as they are."""
    low = "".join(chr(c) for c in range(33, min(threshold, 127)))
    return F.length(quals) - F.length(F.translate(quals, low, "")) if low else F.lit(0)


def block_low(rank: Column, parts: int, n: Column) -> Column:
    return F.expr("0") + F.floor(rank * n / parts)


def block_owner(index: Column, parts: int, n: Column) -> Column:
    """Part that holds an index when n items are cut into contiguous blocks."""
    return F.floor((F.lit(parts) * (index + 1) - 1) / n)
