"""Box geometry of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_of_points(xs: Column, ys: Column) -> Column:
    """Smallest whole-number box around points, halves to even."""
    return F.struct(*[F.bround(f(v)).cast("int").alias(n) for n, f, v in (("x0", F.array_min, xs), ("y0", F.array_min, ys), ("x1", F.array_max, xs), ("y1", F.array_max, ys))])


def valid_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.coalesce((x0 >= 0) & (y0 >= 0) & (x1 > x0) & (y1 > y0), F.lit(False))


def vertical_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared height as a share of the lesser height."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0)) / F.greatest(F.lit(1), F.least(a1 - a0, b1 - b0))


def inside(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column, margin: int = 2) -> Column:
    return x.between(x0 - margin, x1 + margin) & y.between(y0 - margin, y1 + margin)


def render_scale(width: Column, height: Column, target: int = 1900) -> Column:
    return F.greatest(F.lit(1.0), target / F.greatest(width, height))


def progress(done: Column, total: Column, start: int = 24, span: int = 37) -> Column:
    """Percent of a phase that begins at ``start``, no more than its end."""
    return F.least(F.lit(start + span), start + F.bround(span * done / total)).cast("int")
