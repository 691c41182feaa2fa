"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_round(p: Column, q: Column, digits: int) -> Column:
    """round(p / q, digits) half-to-even, computed exactly in integers.

    ``p`` and ``q`` are non-negative integer expressions; 0.0 when q = 0.
    Rounding the exact rational (not its binary double) gives the same value
    in Spark and in any SQL engine with integer division.
    """
    scale = 10 ** digits
    num = p.cast("long") * (2 * scale) + q.cast("long")
    den = q.cast("long") * 2
    rem = F.pmod(num, den)
    quot = ((num - rem) / den).cast("long")
    quot = F.when((rem == 0) & (F.pmod(quot, F.lit(2)) == 1), quot - 1).otherwise(quot)
    return F.when(q > 0, quot / F.lit(float(scale))).otherwise(F.lit(0.0))


def md5_unit(key: Column, salt: str) -> Column:
    """Deterministic uniform in [0, 1) from md5(key || '-' || salt).

    Depends only on (key, salt): identical on any partitioning and
    reproducible in any engine that has md5.
    """
    h = F.md5(F.concat(key.cast("string"), F.lit("-" + salt)).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def md5_order_key(key: Column, salt: str) -> Column:
    """32-bit integer order key from md5 (for seeded shuffles and splits)."""
    h = F.md5(F.concat(key.cast("string"), F.lit("-" + salt)).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def round_fixed(c: Column, digits: int = 6) -> Column:
    """floor(c * 10^digits + 0.5) / 10^digits.

    Reported doubles are rounded with this one IEEE formula (multiply, add,
    floor, divide) so any engine that evaluates it on the same double gets
    the same answer, ties included; ``round`` differs between engines
    exactly at decimal ties.
    """
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def exact_mean(c: Column) -> Column:
    """Mean from an exact decimal sum (values at 1e-10 resolution), then one
    division: the result does not depend on summation order, so it is the
    same double on every run and in every engine."""
    return F.sum(c.cast("decimal(27,10)")).cast("double") / F.count(c)


def half_even_text(c: Column, digits: int = 0) -> Column:
    """A non-negative double as text with ``digits`` decimals, ties to the
    even digit (``format_string`` rounds them up): the double times
    10^digits, rounded by IEEE ``rint``, written as whole and decimal part."""
    scaled = F.rint(c * F.lit(float(10 ** digits))).cast("decimal(38,0)")
    if not digits:
        return scaled.cast("string")
    text = F.lpad(scaled.cast("string"), F.greatest(F.length(scaled.cast("string")), F.lit(digits + 1)), F.lit("0"))
    whole = F.length(text) - digits
    return F.concat(F.substring(text, F.lit(1), whole), F.lit("."), F.substring(text, whole + 1, F.lit(digits)))
