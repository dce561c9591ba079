"""Rectangles, matrices and raster sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def area(r: Column) -> Column:
    return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])


def intersect(a: Column, b: Column) -> Column:
    """Null where they only touch or don't meet."""
    x0, y0, x1, y1 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x1 > x0) & (y1 > y0), rect(x0, y0, x1, y1))


def union_bounds(r: Column) -> tuple[Column, Column, Column, Column]:
    """Aggregates: the bounding box of all rectangles that have an area."""
    ok = area(r) > 0
    return F.min(F.when(ok, r["x0"])), F.min(F.when(ok, r["y0"])), F.max(F.when(ok, r["x1"])), F.max(F.when(ok, r["y1"]))


def coverage(bounds_area: Column, page_area: Column) -> Column:
    return F.when(F.coalesce(page_area, F.lit(0)) <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(bounds_area, F.lit(0.0)) / page_area))


def nearly_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= EPSILON


def apply_matrix(m: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def multiply(m: dict[str, Column], n: dict[str, Column]) -> dict[str, Column]:
    return {
        "a": m["a"] * n["a"] + m["b"] * n["c"], "b": m["a"] * n["b"] + m["b"] * n["d"], "c": m["c"] * n["a"] + m["d"] * n["c"], "d": m["c"] * n["b"] + m["d"] * n["d"],
        "e": m["e"] * n["a"] + m["f"] * n["c"] + n["e"], "f": m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    }


def scale_factors(m: dict[str, Column]) -> tuple[Column, Column]:
    return F.hypot(m["a"], m["b"]), F.hypot(m["c"], m["d"])


def orientation(dx: Column, dy: Column) -> Column:
    """Direction of writing in steps of 15 degrees."""
    return F.round(F.atan2(dy, dx) / (F.pi() / 12)).cast("int")


def fit(width: Column, height: Column, dpi: Column, max_pixels: Column) -> tuple[Column, Column]:
    """Pixels of a page at a resolution, scaled down where it has too many."""
    w, h = width * dpi / 72, height * dpi / 72
    over = w * h > max_pixels
    k = F.sqrt(max_pixels / (w * h))
    size = lambda v: F.greatest(F.lit(1), F.when(over, F.floor(v * k)).otherwise(F.ceil(v))).cast("long")
    return size(w), size(h)


def grid_rect(l0: Column, t0: Column, l1: Column, t1: Column, width: Column, height: Column, grid: int = 500) -> Column:
    """A box on a grid with its origin at the top left, in points from the bottom left."""
    return rect(l0 * width / grid, height - t1 * height / grid, l1 * width / grid, height - t0 * height / grid)
