"""Boxes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contained(ix, iy, iw, ih, ox, oy, ow, oh, tolerance: float = 1.0) -> Column:
    """Whether the inner box lies in the outer one, up to the tolerance on each side."""
    return (ix >= ox - tolerance) & (iy >= oy - tolerance) & (ix + iw <= ox + ow + tolerance) & (iy + ih <= oy + oh + tolerance)


def overlap_ratio(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Common area over the smaller area; 0 without a common area."""
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    small = F.least(aw * ah, bw * bh)
    return F.when((w > 0) & (h > 0) & (small > 0), w * h / small).otherwise(0.0)


def visual_tokens(width: Column, height: Column, patch: int = 28, cap: int | None = None) -> Column:
    area = width * height if cap is None else F.least(width * height, F.lit(cap))
    return area / float(patch * patch)
