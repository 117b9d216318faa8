"""Scores over motion history and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.geometry import col


def velocity_consistency(history, vx, vy) -> Column:
    """How well (vx, vy) continues an array<struct<vx,vy>> ordered oldest first; 0.5 below three entries."""
    hist = col(history)
    n = F.size(hist)
    weight = (n * (n + 1) / F.lit(2)).cast("double")

    def mean(field: str) -> Column:
        weighted = F.transform(hist, lambda v, i: v[field] * (i + 1))
        return F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v) / weight

    px, py, cx, cy = mean("vx"), mean("vy"), col(vx), col(vy)
    p = F.sqrt(px * px + py * py)
    c = F.sqrt(cx * cx + cy * cy)
    tiny = F.lit(1e-6)
    cosine = (px * cx + py * cy) / (p * c)
    direction = (
        F.when((p < tiny) | (c < tiny), F.when((p > 2) & (c < 1), F.lit(0.0)).otherwise(F.lit(0.5)))
        .otherwise(F.greatest(F.lit(0.0), (cosine + 1) / 2))
    )
    size = (
        F.when(p < tiny, F.when(c < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - c / 50)))
        .otherwise(F.greatest(F.lit(0.0), 1 - F.abs(c - p) / (p + tiny)))
    )
    return F.when(n < 3, F.lit(0.5)).otherwise(direction * 0.65 + size * 0.35)


def size_consistency(area, mean_area, n_history) -> Column:
    """Gaussian in the log area ratio, sigma 0.5; neutral below five observations."""
    ratio = F.log(col(area) / col(mean_area))
    return F.when(col(n_history) < 5, F.lit(0.5)).otherwise(F.exp(ratio * ratio * F.lit(-0.5) / F.lit(0.25)))


def interval_iou(a_start, a_end, b_start, b_end) -> Column:
    """Intersection over union of frame intervals with inclusive ends."""
    inter = F.greatest(F.lit(0), F.least(col(a_end), col(b_end)) - F.greatest(col(a_start), col(b_start)) + 1)
    union = F.greatest(col(a_end), col(b_end)) - F.least(col(a_start), col(b_start)) + 1
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
