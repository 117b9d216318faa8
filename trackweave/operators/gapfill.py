"""From sparse observations to one box per frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.geometry import clamp_box, crop_fixed, crop_padded, distance, shift_box
from trackweave.operators.series import CHUNK_FRAMES, FRAME, VIDEO, running

BOX = ("x1", "y1", "x2", "y2")


def frame_spine(videos: DataFrame, *, keys: Sequence[str] = VIDEO, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """One row per frame of every video; built chunk by chunk so a long video spreads over tasks.

    The rows are dealt before they multiply.  Spark takes them to be as few as the videos, hence the hint: joins sort and merge them
    and never send them whole through the driver.
    """
    n = F.col("n_frames")
    last_chunk = F.floor((n - 1) / F.lit(chunk)).cast("long")
    blocks = videos.where(n > 0).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)).alias("_block")
    )
    blocks = blocks.repartition(int(videos.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_block")
    start = F.col("_block") * F.lit(chunk)
    end = F.least(n, start + F.lit(chunk)) - 1
    return blocks.select(*keys, F.explode(F.sequence(start, end)).alias(FRAME), "img_w", "img_h").hint("merge")


def around_gaps(track: DataFrame, videos: DataFrame, *, keys: Sequence[str] = VIDEO, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Every frame with its observation (`_o`) and the observations at or around it (`_a`, `_b`)."""
    keys = list(keys)
    synthetic = F.col("of_synthetic") if "of_synthetic" in track.columns else F.lit(False)
    seen = track.select(
        *keys, FRAME, F.struct(F.col(FRAME), *[F.col(c) for c in BOX], "confidence", synthetic.alias("of_synthetic")).alias("_o")
    )
    rows = frame_spine(videos, keys=keys, chunk=chunk).join(seen, [*keys, FRAME], "left")
    return running(rows, keys=keys, lasts={"_a": F.col("_o")}, firsts={"_b": F.col("_o")}, chunk=chunk)


def linear_box(img_w: Column, img_h: Column, strict: bool) -> dict[str, Column]:
    """Rounded linear blend of the anchors `_a` and `_b`.

    The lenient clamp bounds the low corner from below and the high corner from above only; the
    strict one also keeps the box at least one pixel large.
    """
    a, b = F.col("_a"), F.col("_b")
    t = (F.col(FRAME) - a[FRAME]) / (b[FRAME] - a[FRAME])
    mix = {c: F.rint(a[c] + t * (b[c] - a[c])).cast("long") for c in BOX}
    if strict:
        return clamp_box(mix["x1"], mix["y1"], mix["x2"], mix["y2"], img_w, img_h)
    zero = F.lit(0).cast("long")
    return {"x1": F.greatest(zero, mix["x1"]), "y1": F.greatest(zero, mix["y1"]),
            "x2": F.least(img_w, mix["x2"]), "y2": F.least(img_h, mix["y2"])}


def gap_columns() -> dict[str, Column]:
    """Anchor frames, gap length and row flags.  Synthetic observations anchor but are not detected."""
    a, b, o = F.col("_a")[FRAME], F.col("_b")[FRAME], F.col("_o")
    synthetic = F.coalesce(o["of_synthetic"], F.lit(False))
    return {
        "fa": a, "fb": b, "gap_len": F.when(a != b, b - a - 1),
        "detected": o.isNotNull() & ~synthetic,
        "interpolated": o.isNull() | synthetic,
        "of_synthetic": synthetic,
        "confidence": F.coalesce(o["confidence"], F.lit(0.0)),
    }


def fill_linear(track: DataFrame, videos: DataFrame, *, keys: Sequence[str] = VIDEO, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """One box per frame: copies before the first and after the last observation, lines between."""
    rows = around_gaps(track, videos, keys=keys, chunk=chunk)
    blend = linear_box(F.col("img_w"), F.col("img_h"), strict=False)
    a, b = F.col("_a"), F.col("_b")
    boxes = {
        c: F.when(a.isNull(), b[c]).when(b.isNull() | (a[FRAME] == b[FRAME]), a[c]).otherwise(blend[c]).alias(c)
        for c in BOX
    }
    filled = rows.where(a.isNotNull() | b.isNotNull())
    return filled.select(*keys, FRAME, *boxes.values(), *[v.alias(k) for k, v in gap_columns().items()], "img_w", "img_h")


def short_gap_or_flow(
    gaps: DataFrame, *, min_gap: int = 10, drift_guard: float = 400.0,
) -> DataFrame:
    """Choose the box of an internal gap frame.

    `gaps` has `_a`, `_b` and the flow estimate fx1..fy2.  Gaps below `min_gap` take the line; longer
    ones take the flow box unless its centre strays more than `drift_guard` from the line.
    """
    a, b = F.col("_a"), F.col("_b")
    t = (F.col(FRAME) - a[FRAME]) / (b[FRAME] - a[FRAME])
    line = linear_box(F.col("img_w"), F.col("img_h"), strict=True)
    # the line's centre takes its size from the left anchor
    lx = a["x1"] + t * (b["x1"] - a["x1"]) + (a["x2"] - a["x1"]) / 2
    ly = a["y1"] + t * (b["y1"] - a["y1"]) + (a["y2"] - a["y1"]) / 2
    drift = distance((F.col("fx1") + F.col("fx2")) / 2, (F.col("fy1") + F.col("fy2")) / 2, lx, ly)
    short = (b[FRAME] - a[FRAME] - 1) < F.lit(min_gap)
    guarded = drift > F.lit(drift_guard) if drift_guard > 0 else F.lit(False)
    source = F.when(short, "line").when(guarded, "guarded").otherwise("flow")
    return gaps.withColumn("fill", source).select(
        *[c for c in gaps.columns], "fill",
        *[F.when(F.col("fill") == "flow", F.col(f"f{c}")).otherwise(line[c]).alias(c) for c in BOX],
    )


def shifted(df: DataFrame) -> DataFrame:
    return df.withColumns(shift_box(*BOX, "dx", "dy", "img_w", "img_h"))


def with_crop(df: DataFrame, *, width: int = 0, height: int = 0, padding: float = 0.2) -> DataFrame:
    """Crop window of each box: fixed size when both sides are given, padded otherwise."""
    if width > 0 and height > 0:
        return df.withColumns(crop_fixed(*BOX, "img_w", "img_h", width, height))
    return df.withColumns(crop_padded(*BOX, "img_w", "img_h", padding))
