"""Box, point and coordinate expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


NUDGE = 2.1e-8


def settled(value, digits: int) -> Column:
    """Rounded for comparison across engines, without negative zero.

    Means of round numbers often lie exactly between two rounded values, where the order of a sum
    decides; a nudge far below the precision kept moves both engines off that point.
    """
    return F.round(col(value) + F.lit(NUDGE), digits) + F.lit(0.0)


def r6(value: Column) -> Column:
    return settled(value, 6)


def half_even(value, digits: int = 0) -> Column:
    """Half-even rounding; used where results are written."""
    return F.rint(col(value)) if digits == 0 else F.bround(col(value), digits)


def with_box_geometry(df: DataFrame) -> DataFrame:
    """Centre, size and area (never below 1) of x1,y1,x2,y2."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return df.withColumns({
        "cx": (F.col("x1") + F.col("x2")) / F.lit(2.0),
        "cy": (F.col("y1") + F.col("y2")) / F.lit(2.0),
        "box_w": w,
        "box_h": h,
        "area": F.greatest(F.lit(1.0), (w * h).cast("double")),
    })


def distance(ax, ay, bx, by) -> Column:
    dx, dy = col(ax) - col(bx), col(ay) - col(by)
    return F.sqrt(dx * dx + dy * dy)


def centre_proximity(cx, cy, img_w, img_h) -> Column:
    """1 at the image centre, 0 at a corner."""
    mx, my = col(img_w) / F.lit(2.0), col(img_h) / F.lit(2.0)
    return F.lit(1.0) - distance(cx, cy, mx, my) / F.sqrt(mx * mx + my * my)


def quality(confidence, cx, cy, img_w, img_h, w_conf: float = 0.3, w_center: float = 0.5) -> Column:
    return F.lit(w_conf) * col(confidence) + F.lit(w_center) * centre_proximity(cx, cy, img_w, img_h)


def clip(value, low, high) -> Column:
    return F.greatest(col(low), F.least(col(value), col(high)))


def clamp_box(x1, y1, x2, y2, img_w, img_h) -> dict[str, Column]:
    """Keep a box inside the image and at least one pixel large; the low corner is settled first."""
    left = clip(x1, F.lit(0), col(img_w) - 1)
    top = clip(y1, F.lit(0), col(img_h) - 1)
    return {
        "x1": left,
        "y1": top,
        "x2": F.greatest(left + 1, F.least(col(x2), col(img_w))),
        "y2": F.greatest(top + 1, F.least(col(y2), col(img_h))),
    }


def shift_box(x1, y1, x2, y2, dx, dy, img_w, img_h) -> dict[str, Column]:
    moved = [F.rint(col(v) + col(d)).cast("long") for v, d in ((x1, dx), (y1, dy), (x2, dx), (y2, dy))]
    return clamp_box(*moved, img_w, img_h)


def crop_fixed(x1, y1, x2, y2, img_w, img_h, width: int, height: int) -> dict[str, Column]:
    """Window of a fixed size, centred on the box and slid inside the image."""
    out: dict[str, Column] = {}
    for axis, a, b, size, limit in (("x", x1, x2, width, img_w), ("y", y1, y2, height, img_h)):
        span = F.least(F.lit(size), col(limit))
        start = F.rint((col(a) + col(b)) / F.lit(2.0) - span / F.lit(2.0)).cast("long")
        start = clip(start, F.lit(0), col(limit) - span)
        out[f"{axis}1"], out[f"{axis}2"] = start, start + span
    return {f"crop_{k}": out[k] for k in ("x1", "y1", "x2", "y2")}


def crop_padded(x1, y1, x2, y2, img_w, img_h, ratio: float) -> dict[str, Column]:
    """Box grown by a ratio of its size; the padding is truncated toward zero."""
    pad_x = ((col(x2) - col(x1)) * F.lit(ratio)).cast("long")
    pad_y = ((col(y2) - col(y1)) * F.lit(ratio)).cast("long")
    return {
        "crop_x1": F.greatest(F.lit(0), col(x1) - pad_x),
        "crop_y1": F.greatest(F.lit(0), col(y1) - pad_y),
        "crop_x2": F.least(col(img_w), col(x2) + pad_x),
        "crop_y2": F.least(col(img_h), col(y2) + pad_y),
    }


def normalise_rect(ax, ay, bx, by) -> dict[str, Column]:
    return {
        "rx1": F.least(col(ax), col(bx)), "ry1": F.least(col(ay), col(by)),
        "rx2": F.greatest(col(ax), col(bx)), "ry2": F.greatest(col(ay), col(by)),
    }


def venue_point(venue_x, venue_y, cx, cy, scale) -> dict[str, Column]:
    return {"athlete_vx": col(venue_x) + col(cx) * col(scale), "athlete_vy": col(venue_y) + col(cy) * col(scale)}


def display_to_map(value, offset, scale, limit) -> Column:
    return clip((col(value) - col(offset)) / col(scale), F.lit(0.0), col(limit) - 1)


def map_to_display(value, scale) -> Column:
    return F.rint(col(value) * col(scale)).cast("long")


def band(value, limits: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first limit the value stays below; the last label otherwise."""
    out = None
    for limit, label in zip(limits, labels):
        test = col(value) < F.lit(float(limit))
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def wrapped_turn(angle, previous) -> Column:
    delta = col(angle) - col(previous)
    return F.abs(F.atan2(F.sin(delta), F.cos(delta)))


def perspective(x, y, h: Sequence) -> dict[str, Column]:
    """Point under a row-major 3x3 matrix given as nine columns or numbers."""
    m = [col(v) for v in h]
    px, py = col(x), col(y)
    scale = m[6] * px + m[7] * py + m[8]
    return {"map_x": (m[0] * px + m[1] * py + m[2]) / scale, "map_y": (m[3] * px + m[4] * py + m[5]) / scale}


def affine(x, y, m: Sequence) -> dict[str, Column]:
    a = [col(v) for v in m]
    px, py = col(x), col(y)
    return {"map_x": a[0] * px + a[1] * py + a[2], "map_y": a[3] * px + a[4] * py + a[5]}


def percent_gain(before, after) -> Column:
    """Relative improvement in percent; null when the base is missing or zero."""
    usable = col(before).isNotNull() & col(after).isNotNull() & (col(before) != 0)
    return F.when(usable, (F.lit(1.0) - col(after) / col(before)) * 100)


def first_present(*candidates) -> Column:
    return F.coalesce(*[col(c) for c in candidates])
