"""Hash families as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def universal(x: Column, a: int, b: int, m: int) -> Column:
    """(a x + b) mod m."""
    return F.pmod(x * F.lit(a) + F.lit(b), F.lit(m))


def double_mod(x: Column, a: int, b: int, p: int, m: int) -> Column:
    """((a x + b) mod p) mod m, for x already below p."""
    return F.pmod(F.pmod(x * F.lit(a) + F.lit(b), F.lit(p)), F.lit(m))


def utf8_mod(text: Column, p: int) -> Column:
    """The text's UTF-8 bytes as one big-endian integer, modulo p.

    The integer itself may have any length; folding byte by byte gives its remainder.
    """
    code = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(code).cast("int"), F.lit(2))
    byte = lambda i: F.conv(F.substr(code, i, F.lit(2)), 16, 10).cast("long")
    folded = F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: F.pmod(acc * 256 + byte(i), F.lit(p)))
    return F.when(F.length(text) > 0, folded)


def trailing_zeros(x: Column) -> Column:
    """Zeros at the end of the binary form; 1 for zero itself."""
    digits = F.bin(x)
    return F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
