"""Exact integer and rational arithmetic as column expressions; nothing here but `rounded` goes through floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def _wide(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(20,0)")


def _divided(p: Column, den: Column) -> tuple[Column, Column]:
    """Quotient and rest of |p| / den, den > 0. Decimal `div` would wrap at 64 bits, so the rest goes first."""
    rest = F.abs(p) % den
    return ((F.abs(p) - rest) / den).cast(WIDE), rest


def divide_half_even(p: Column, den: Column) -> Column:
    """p / den rounded to the nearest integer, ties to even, as a decimal; den > 0."""
    q, rest = _divided(p.cast(WIDE), den.cast(WIDE))
    up = (2 * rest > den) | ((2 * rest == den) & (q % 2 == 1))
    return (F.signum(p).cast("int") * (q + F.when(up, 1).otherwise(0))).cast(WIDE)


def rescale(value: Column, anchor: Column, to: Column, num: Column, den: Column) -> Column:
    """to + (value - anchor) * num / den, ties to even, as a long; an overflow raises (ANSI mode)."""
    product = ((_wide(value) - _wide(anchor)).cast("decimal(19,0)") * num.cast("decimal(19,0)")).cast(WIDE)
    return (divide_half_even(product, den) + _wide(to)).cast("long")


def rescale_half_up(pts: Column, first: Column, num: Column, den: Column, unit: int = 1_000_000_000) -> Column:
    """(pts - first) * num / den seconds in units of 1 / unit s, ties up; null where it would be negative.

    Where the products stay far within 64 bits, as most do, they are longs: decimals take many times as long."""
    p, f, n, d = (c.cast("double") for c in (pts, first, num, den))
    small = (F.abs(p) < float(1 << 61)) & (F.abs(f) < float(1 << 61)) & (F.abs((p - f) * n * unit) < float(1 << 60)) & (d >= 1) & (d < float(1 << 60))
    parts = (pts.cast("long") - first.cast("long")) * num.cast("long") * F.lit(unit).cast("long")
    in_longs = F.when(parts >= 0, F.call_function("div", 2 * parts + den.cast("long"), 2 * den.cast("long")))
    product = ((_wide(pts) - _wide(first)).cast("decimal(19,0)") * num.cast("decimal(10,0)")).cast("decimal(29,0)") * F.lit(unit).cast("decimal(10,0)")
    twice = (2 * product.cast(WIDE) + den.cast(WIDE)).cast(WIDE)
    q, _ = _divided(twice, (2 * den).cast(WIDE))
    return F.when(small, in_longs).otherwise(F.when(product >= 0, q.cast("long")))


def drift_ppm(num: Column, den: Column) -> Column:
    return (num - den).cast("double") * 1e6 / den.cast("double")


def decimal_6(num: Column, den: Column) -> Column:
    """num / den with six decimals, ties to even, as text; num >= 0, den > 0."""
    millionths = divide_half_even(num.cast("decimal(28,0)") * F.lit(1_000_000).cast("decimal(7,0)"), den)
    whole, rest = _divided(millionths, F.lit(1_000_000).cast(WIDE))
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 6, "0"))


def removed_rows(kind: Column, cut: Column) -> Column:
    """Rows that a cut of so many 30 Hz frames removes from 30, 50 and 250 Hz files; null for other kinds."""
    cut = cut.cast("long")
    third = lambda c: F.call_function("div", c - F.pmod(c, F.lit(3)), F.lit(3).cast("long"))
    return F.when(kind == "csv", cut).when(kind == "mot", third(cut * 5)).when(kind == "raw", third(cut * 25))


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as SQL's round on doubles does it: scaled, to the nearest whole number (ties away from zero), scaled back, all in doubles. Where the
    scaled value exceeds 2**53 this keeps its rounding; Spark's own round goes through decimals and doesn't."""
    scale = float(10**digits)
    y = value * scale
    size = F.abs(y)
    whole = F.floor(size).cast("double")
    near = F.when(size >= float(1 << 52), size).otherwise(whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0))
    out = F.when(y < 0, -near).otherwise(near) / scale
    return F.when(size < float("inf"), out).otherwise(value)


def nanoseconds(ts: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) * 1000
