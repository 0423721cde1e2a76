"""Fixed-length windows of reads.

A read of length L has windows at the starts p <= L - length whose bases are all clean. If
none of them starts before L - length, the read gives no window at all; so one of exactly
the window's length never does.

Bases become the digits 0 to 3 once a read. A window is then a piece of that string, read as
a decimal number in generated code: one or two longs. They group like identifiers, and only
what is left after grouping is turned into those. Ambiguous bases and low qualities are
strings of the digits 0 and 1 that are read in the same way.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec

#: Digits of one decimal part. Flags of at most 17 digits can be counted by one remainder.
PART = 16


def _parts(length: int) -> list[tuple[int, int, str]]:
    """(place, digits, column) of a window's decimal parts."""
    cuts = [(0, length)] if length <= PART else [(0, length - PART), (length - PART, PART)]
    return [(at, n, f"d{i}") for i, (at, n) in enumerate(cuts)]


def digit_columns(length: int) -> list[str]:
    return [c for _, _, c in _parts(length)]


def _base4(name: str, digits: int) -> Column:
    """The decimal digits of a column, 0 to 3 each, read in base 4.

    Taking off 6 * 4^(i - 1) times x div 10^i for each i leaves the digit at i a weight of 4^i.
    """
    return F.expr(name + "".join(f" - {6 * 4 ** (i - 1)} * ({name} div {10 ** i})" for i in range(1, digits)))


def identifier(length: int) -> Column:
    """Packed identifier of the decimal parts of a window."""
    parts = [_base4(c, n) for _, n, c in _parts(length)]
    return parts[0] if len(parts) == 1 else F.shiftleft(parts[0], 2 * PART).bitwiseOR(parts[1])


def _flagged(digits: Column) -> Column:
    """How many of the digits 0 and 1 of a number of at most 17 places are 1.

    The remainder by 99 adds up the pairs of digits: ten times one half and the other half.
    """
    pairs = digits % 99
    return F.floor(pairs / 10).cast("int") + (pairs % 10).cast("int")


def window_digits(reads: DataFrame, length: int, params=None, carry: tuple[str, ...] = (), quality: bool = True) -> DataFrame:
    """(read_id, pos, d0[, d1]) of every window of at most 32 bases; with params, only those of good quality.

    Good quality: at most ``max_bad`` characters of the window below ``quality_threshold``.
    Quality is tested after the rule on starts. A window that starts before L - length lies
    in the read less its last base, so one pattern on the read decides the rule. ``carry``
    names more columns of ``reads`` to keep. Without ``quality`` windows of bad quality stay
    and a column ``good`` tells them apart. Null reads, and with params null qualities, give
    no window.
    """
    if not 1 <= length <= 32:
        raise ValueError("windows hold 1 to 32 bases")
    r, keep = F.col("r"), ["read_id", *carry]
    long = reads.where(F.length("bases") > length).select(*keep, F.upper("bases").alias("r"), *([F.col("quals").alias("q")] if params is not None else []))
    clean = F.translate(r, codec.BASES, "") == ""
    ruled = long.where(clean | F.substr(r, F.lit(1), F.length(r) - 1).rlike(f"[ACGT]{{{length}}}"))
    codes = F.translate(F.regexp_replace(r, "[^ACGT]", "A"), codec.BASES, "0123")
    flags = {"n": F.when(~clean, F.regexp_replace(F.translate(r, codec.BASES, "0000"), "[^0]", "1"))}
    if params is not None:
        ruled = ruled.where("q IS NOT NULL")
        chars = "".join(chr(c) for c in range(33, 127))
        low = F.translate("q", chars, "".join("1" if ord(c) < params.quality_threshold else "0" for c in chars))
        flags["f"] = F.rpad(F.regexp_replace(low, "[^01]", "0"), F.length(r), F.lit("0"))
    ready = ruled.select(*keep, codes.alias("b"), *[x.alias(c) for c, x in flags.items()])
    each = ready.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("b") - length)))

    def number(c: str, at: int, n: int) -> Column:
        return F.substr(F.col(c), F.col("pos") + (at + 1), F.lit(n)).cast("long")

    parts = _parts(length)
    each = each.where(F.col("n").isNull() | reduce(and_, [number("n", at, n) == 0 for at, n, _ in parts]))
    out = [*keep, "pos", *[number("b", at, n).alias(c) for at, n, c in parts]]
    if params is None:
        return each.select(*out)
    good = reduce(add, [_flagged(number("f", at, n)) for at, n, _ in parts]) <= params.max_bad
    return each.where(good).select(*out) if quality else each.select(*out, good.alias("good"))


def window_ids(reads: DataFrame, length: int, params=None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(read_id, pos, id) of the same windows."""
    return window_digits(reads, length, params, carry).select("read_id", *carry, "pos", identifier(length).alias("id"))


def windows(reads: DataFrame, length: int, params=None) -> DataFrame:
    """(read_id, pos, bases) of the same windows, bases in upper case."""
    return window_ids(reads, length, params).select("read_id", "pos", F.upper(codec.unpack(F.col("id"), length)).alias("bases"))
