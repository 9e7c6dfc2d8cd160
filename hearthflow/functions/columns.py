"""Small Column helpers shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column | str, low, high) -> Column:
    """Bound a value; null stays null (`greatest` and `least` alone would skip it)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def lenient_double(c: Column | str) -> Column:
    """Text to DOUBLE; anything that is not a plain number, NaN included, becomes null."""
    text = as_col(c).cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def known(c: Column | str) -> Column:
    """Turn NaN into null so that one null check covers both."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def micros(c: Column | str) -> Column:
    return F.unix_micros(as_col(c))


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def one_decimal(c: Column | str) -> Column:
    return F.format_string("%.1f", as_col(c).cast("double"))


def unsigned_at(payload: Column | str, position: int, size: int = 1) -> Column:
    """Big-endian unsigned number of up to 7 bytes at a 0-based position of a BINARY column."""
    return F.conv(F.hex(F.substring(as_col(payload), position + 1, size)), 16, 10).cast("bigint")


def byte_of(word: Column | str, shift: int) -> Column:
    """The byte of a number that starts `shift` bits up."""
    return F.shiftright(as_col(word), shift).bitwiseAND(0xFF).cast("int")


def little_endian_u32(word: Column | str) -> Column:
    """Read the four bytes of a big-endian number the other way round."""
    parts = [
        F.shiftleft(F.shiftright(as_col(word), 8 * i).bitwiseAND(0xFF), 24 - 8 * i)
        for i in range(4)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def fold_xor(word: Column | str) -> Column:
    """XOR of all bytes of a number."""
    word = as_col(word)
    for bits in (32, 16, 8):
        word = word.bitwiseXOR(F.shiftright(word, bits))
    return word.bitwiseAND(0xFF).cast("int")
