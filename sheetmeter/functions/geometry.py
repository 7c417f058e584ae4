"""Box arithmetic as column expressions; boxes are columns or struct fields x, y, w, h in points, y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(b: Column | str, field: str) -> Column:
    """The field of a struct column, or the column named field (with the prefix b if b is a string)."""
    return F.col(f"{b}{field}") if isinstance(b, str) else b[field]


def center(b="") -> tuple[Column, Column]:
    return col(b, "x") + col(b, "w") / 2, col(b, "y") + col(b, "h") / 2


def contains_point(b, px: Column, py: Column) -> Column:
    """Closed on all four sides."""
    return (px >= col(b, "x")) & (px <= col(b, "x") + col(b, "w")) & (py >= col(b, "y")) & (py <= col(b, "y") + col(b, "h"))


def center_inside(outer, inner) -> Column:
    return contains_point(outer, *center(inner))


def box(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def from_corners(x1, y1, x2, y2) -> Column:
    return box(F.least(x1, x2), F.least(y1, y2), F.abs(x2 - x1), F.abs(y2 - y1))


def expand(b, dx, dy=None) -> Column:
    dy = dx if dy is None else dy
    return box(col(b, "x") - dx, col(b, "y") - dy, col(b, "w") + 2 * dx, col(b, "h") + 2 * dy)


def clamp_to_page(b, width, height) -> Column:
    zero = F.lit(0.0)
    x, y = F.greatest(zero, col(b, "x")), F.greatest(zero, col(b, "y"))
    return box(x, y, F.greatest(zero, F.least(width, col(b, "x") + col(b, "w")) - x), F.greatest(zero, F.least(height, col(b, "y") + col(b, "h")) - y))


def intersection_area(a, b) -> Column:
    w = F.least(col(a, "x") + col(a, "w"), col(b, "x") + col(b, "w")) - F.greatest(col(a, "x"), col(b, "x"))
    h = F.least(col(a, "y") + col(a, "h"), col(b, "y") + col(b, "h")) - F.greatest(col(a, "y"), col(b, "y"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a, b) -> Column:
    common = intersection_area(a, b)
    return F.when(common == 0, 0.0).otherwise(common / (col(a, "w") * col(a, "h") + col(b, "w") * col(b, "h") - common))


def scale_box(b, f) -> Column:
    return box(*[col(b, k) * f for k in "xywh"])


def rounded(n: Column, places: int = 1) -> Column:
    """Half rounds towards plus infinity, unlike Spark's round."""
    return F.floor(n * 10.0**places + 0.5).cast("double") / 10.0**places


def round_box(b, places: int = 1) -> Column:
    return box(*[rounded(col(b, k), places) for k in "xywh"])


def union_box() -> Column:
    """Aggregate: the bounding box of the columns x, y, w, h; null for no rows."""
    x, y = F.min("x"), F.min("y")
    return F.when(F.count("x") > 0, box(x, y, F.max(F.col("x") + F.col("w")) - x, F.max(F.col("y") + F.col("h")) - y))


def pdf_box(height: Column, b="") -> Column:
    """Viewport box to PDF coordinates on an unrotated page."""
    return box(col(b, "x"), height - col(b, "y") - col(b, "h"), col(b, "w"), col(b, "h"))


def tile_box_to_page(raw: Column, px, py, size_w, size_h, dpi) -> Column:
    """A [ymin, xmin, ymax, xmax] box on 0 to 1000 inside a pixel tile, in page points; null under one pixel or if short."""
    at = lambda i: F.get(raw, F.lit(i))
    x1, x2 = F.least(at(1), at(3)) / 1000 * size_w, F.greatest(at(1), at(3)) / 1000 * size_w
    y1, y2 = F.least(at(0), at(2)) / 1000 * size_h, F.greatest(at(0), at(2)) / 1000 * size_h
    f = F.lit(72.0) / dpi
    return F.when((F.size(raw) >= 4) & (x2 - x1 >= 1) & (y2 - y1 >= 1), box((px + x1) * f, (py + y1) * f, (x2 - x1) * f, (y2 - y1) * f))


def edge_margin(px, py, size_w, size_h, dpi, b="") -> Column:
    """Points from a box's centre to the nearest edge of its tile."""
    cx, cy = center(b)
    f = F.lit(72.0) / dpi
    return F.least(cx - px * f, (px + size_w) * f - cx, cy - py * f, (py + size_h) * f - cy)
