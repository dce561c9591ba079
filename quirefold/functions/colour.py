"""Colours and samples as column expressions, each component from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp8(c: Column) -> Column:
    """0 to 255, half up."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) * 255 + 0.5).cast("int")


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    return tuple((1 - x) * (1 - k) for x in (c, m, y))


def unblended(c: Column, matte: Column, alpha: Column) -> Column:
    """A component before it was blended with a matte; the matte itself where nothing of it is left."""
    free = F.least(F.lit(1.0), F.greatest(F.lit(0.0), matte + (c - matte) / alpha))
    return F.when(alpha >= 1, c).when(alpha <= 0, matte).otherwise(free)


def decoded(c: Column, low: Column, high: Column) -> Column:
    """A sample on the range of its decode array."""
    return low + c * (high - low)


def bit_field(data: Column, at: Column, width: int) -> Column:
    """`width` bits (32 at most) from a place on, the most significant first; null beyond the end."""
    if not 0 < width <= 32:
        raise ValueError("1 to 32 bits")
    digits = F.substring(F.hex(data), (F.floor(at / 8) * 2 + 1).cast("int"), F.lit(10))
    padded = F.rpad(digits, 10, "0")
    value = F.conv(padded, 16, 10).cast("decimal(20,0)").cast("long")
    shift = (F.lit(40 - width) - at % 8).cast("int")
    taken = F.floor(value / F.pow(F.lit(2.0), shift)).cast("long") % (1 << width)
    return F.when(at + width <= F.octet_length(data) * 8, taken)
