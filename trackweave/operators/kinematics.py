"""Velocity, camera compensation, smoothing and cumulative motion over dense tracks.

These expect one row per frame (frames 0..n-1), so windows with a bounded reach are cut into
frame chunks with halos and never need a whole video in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import distance, wrapped_turn
from trackweave.operators.evaluate import distribution
from trackweave.operators.series import CHUNK_FRAMES, FRAME, VIDEO, halo_chunks, halo_window, running


@dataclass(frozen=True)
class VelocityParams:
    smooth_window: int = 5
    normalize_by_height: bool = False
    jump_vy: float = 3.0
    min_airtime: int = 5


def first_difference(value: str, window) -> Column:
    return F.coalesce(F.col(value) - F.lag(value).over(window), F.lit(0.0))


def zoom_corrected(flow: DataFrame, boxes: DataFrame) -> DataFrame:
    """Flow divided by sqrt(area / mean positive area of the video); rows without area unchanged."""
    area = F.greatest(F.col("x2") - F.col("x1"), F.lit(1)) * F.greatest(F.col("y2") - F.col("y1"), F.lit(1))
    sized = boxes.select(*VIDEO, FRAME, F.when(F.col("x1").isNotNull(), area).alias("area"))
    mean = sized.groupBy(*VIDEO).agg(F.avg("area").alias("mean_area"))
    joined = flow.join(sized, [*VIDEO, FRAME], "left").join(mean, list(VIDEO), "left")
    zoom = F.coalesce(F.sqrt(F.col("area") / F.col("mean_area")), F.lit(1.0))
    return joined.select(*flow.columns[:2], (F.col("dx") / zoom).alias("dx"), (F.col("dy") / zoom).alias("dy"))


def velocity_table(
    track: DataFrame, flow: DataFrame, params: VelocityParams = VelocityParams(), *,
    box: Sequence[str] = ("crop_x1", "crop_y1", "crop_x2", "crop_y2"), chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Pixel, camera-compensated and smoothed speed, acceleration, jerk and turning per frame.

    Centres come from the padded box; the first row of every difference is 0.  Frames without flow
    count as zero camera motion.  The moving average always divides by 2w+1, also at the ends.
    One shuffle: every window runs on the same chunks, with a halo wide enough for all of them.
    """
    x1, y1, x2, y2 = box
    w = params.smooth_window
    rows = track.join(flow.select(*VIDEO, FRAME, F.col("dx").alias("flow_dx"), F.col("dy").alias("flow_dy")), [*VIDEO, FRAME], "left")
    rows = rows.select(
        *VIDEO, FRAME, ((F.col(x1) + F.col(x2)) / 2.0).alias("center_x"), ((F.col(y1) + F.col(y2)) / 2.0).alias("center_y"),
        F.greatest(F.lit(1.0), (F.col(y2) - F.col(y1)).cast("double")).alias("height"),
        F.coalesce("flow_dx", F.lit(0.0)).alias("flow_dx"), F.coalesce("flow_dy", F.lit(0.0)).alias("flow_dy"),
    )
    # difference, smoothing over w, then two more differences reach w + 3 rows back
    cut = halo_chunks(rows, FRAME, before=w + 3, after=w, chunk=chunk)
    win = Window.partitionBy(*VIDEO, "_chunk").orderBy(FRAME)
    cut = cut.withColumns({"vel_dx": first_difference("center_x", win), "vel_dy": first_difference("center_y", win)})
    scale = F.col("height") if params.normalize_by_height else F.lit(1.0)
    cut = cut.withColumns({
        "comp_dx": (F.col("vel_dx") - F.col("flow_dx")) / scale, "comp_dy": (F.col("vel_dy") - F.col("flow_dy")) / scale})
    cut = cut.withColumns({
        "speed": F.sqrt(F.col("comp_dx") * F.col("comp_dx") + F.col("comp_dy") * F.col("comp_dy")),
        "angle": F.atan2(F.col("comp_dy"), F.col("comp_dx") + 1e-9)})
    smooth = F.sum("speed").over(win.rowsBetween(-w, w)) / F.lit(float(2 * w + 1))
    cut = cut.withColumns({
        "speed_smoothed": smooth if w > 0 else F.col("speed"),
        "turn": F.coalesce(wrapped_turn(F.col("angle"), F.lag("angle").over(win)), F.lit(0.0))})
    cut = cut.withColumn("acceleration", first_difference("speed_smoothed", win))
    cut = cut.withColumn("jerk", first_difference("acceleration", win))
    return cut.where("_own").drop("_own", "_chunk", "angle")


def velocity_summary(velocity: DataFrame, jumps: DataFrame | None = None) -> DataFrame:
    out = velocity.groupBy(*VIDEO).agg(
        F.avg("speed").alias("mean_speed"), F.max("speed").alias("max_speed"), F.avg("comp_dy").alias("mean_vy"),
        (F.lit(1.0) / (F.avg(F.abs("jerk")) + 1e-6)).alias("smoothness"), F.avg("turn").alias("mean_curvature"))
    if jumps is None:
        return out
    counts = jumps.groupBy(*VIDEO).agg(F.count(F.lit(1)).alias("n"))
    return out.join(counts, list(VIDEO), "left").withColumn("n_jumps", F.coalesce("n", F.lit(0).cast("long"))).drop("n")


def frame_jumps(track: DataFrame, limit: float, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Frame-to-frame displacements above the limit."""
    moved = halo_window(
        track, lambda w: {"_px": F.lag("cx").over(w), "_py": F.lag("cy").over(w)}, before=1, chunk=chunk)
    return moved.withColumn("jump", distance("cx", "cy", "_px", "_py")).where(F.col("jump") > limit).drop("_px", "_py")


def cumulative_flow(flow: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    return running(flow, sums={"cum_dx": F.col("dx"), "cum_dy": F.col("dy")}, chunk=chunk)


def arc_length(points: DataFrame, x: str, y: str, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Path length from the first row; rows need not be dense."""
    step = running(points, prevs={"_q": F.struct(F.col(x).alias("x"), F.col(y).alias("y"))}, chunk=chunk)
    step = step.withColumn("_d", F.coalesce(distance(x, y, F.col("_q.x"), F.col("_q.y")), F.lit(0.0)))
    return running(step, sums={"arc": F.col("_d")}, chunk=chunk).drop("_q", "_d")


def running_mean_error(errors: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    return running(errors, sums={"_s": F.col("error"), "_n": F.lit(1)}, chunk=chunk).withColumn(
        "mean_so_far", F.col("_s") / F.col("_n")).drop("_s", "_n")


def trailing_positions(track: DataFrame, n: int, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """The last n positions up to each frame of a dense track."""
    return halo_window(
        track, lambda w: {"trail": F.collect_list(F.struct("cx", "cy")).over(w.rowsBetween(-(n - 1), 0))},
        before=n - 1, chunk=max(chunk, n))


def masked_flow(
    pixels: DataFrame, boxes: DataFrame, *, dark: float = 80.0, min_gradient: float = 5.0, min_pixels: int = 50,
) -> DataFrame:
    """Median background flow per frame over dark, textured pixels outside the box.

    Below `min_pixels` masked pixels, the median over all pixels outside the box; (0, 0) if none.
    A frame has at most one row per pixel, so `percentile` buffers stay small.
    """
    joined = pixels.join(boxes.select(*VIDEO, FRAME, "x1", "y1", "x2", "y2"), [*VIDEO, FRAME], "left")
    inside = (
        (F.col("px") >= F.greatest(F.col("x1"), F.lit(0))) & (F.col("px") < F.col("x2"))
        & (F.col("py") >= F.greatest(F.col("y1"), F.lit(0))) & (F.col("py") < F.col("y2")))
    outside = ~F.coalesce(inside, F.lit(False))
    masked = outside & (F.col("gray") < dark) & (F.col("grad") > min_gradient)

    def med(c: str, keep: Column) -> Column:
        return F.percentile(F.when(keep, F.col(c)), 0.5)

    out = joined.groupBy(*VIDEO, FRAME).agg(
        F.count_if(masked).alias("n_masked"), med("dx", masked).alias("mx"), med("dy", masked).alias("my"),
        med("dx", outside).alias("ox"), med("dy", outside).alias("oy"))
    enough = F.col("n_masked") >= min_pixels
    return out.select(
        *VIDEO, FRAME, "n_masked", enough.alias("used_mask"),
        F.coalesce(F.when(enough, F.col("mx")).otherwise(F.col("ox")), F.lit(0.0)).alias("dx"),
        F.coalesce(F.when(enough, F.col("my")).otherwise(F.col("oy")), F.lit(0.0)).alias("dy"))


def point_displacement(points: DataFrame, *, min_points: int = 5) -> DataFrame:
    """Robust displacement of tracked points per frame: points beyond 3 MAD of the median are dropped.

    Needs `min_points` points, max(3, min_points // 2) tracked ones and two inliers; (0, 0) and
    method `none` otherwise.  Points per frame are few (tens), so `percentile` is safe here.
    """
    key = [*VIDEO, FRAME]
    ok = F.col("ok")
    first = points.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(ok).alias("n_ok"),
        F.percentile(F.when(ok, F.col("dx")), 0.5).alias("mdx"), F.percentile(F.when(ok, F.col("dy")), 0.5).alias("mdy"))
    usable = (F.col("n_points") >= min_points) & (F.col("n_ok") >= max(3, min_points // 2))
    centred = points.where(ok).join(first.where(usable), key).withColumns({
        "ax": F.abs(F.col("dx") - F.col("mdx")), "ay": F.abs(F.col("dy") - F.col("mdy"))})
    spread = centred.groupBy(*key).agg(
        F.greatest(F.percentile("ax", 0.5), F.lit(1e-6)).alias("sx"), F.greatest(F.percentile("ay", 0.5), F.lit(1e-6)).alias("sy"))
    inlier = centred.join(spread, key).where((F.col("ax") < F.col("sx") * 3) & (F.col("ay") < F.col("sy") * 3))
    found = inlier.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_inliers"), F.percentile("dx", 0.5).alias("dx"), F.percentile("dy", 0.5).alias("dy"))
    good = F.col("n_inliers") >= 2
    return first.select(*key, "n_points").join(found, key, "left").select(
        *key, "n_points", F.coalesce("n_inliers", F.lit(0).cast("long")).alias("n_inliers"),
        F.when(good, F.col("dx")).otherwise(0.0).alias("dx"), F.when(good, F.col("dy")).otherwise(0.0).alias("dy"),
        F.when(good, "sparse").otherwise("none").alias("method"))


def method_summary(flow: DataFrame) -> DataFrame:
    """`none`, the single method used, or `mixed` per video."""
    used = F.when(F.col("method") != "none", F.col("method"))
    lo, hi = F.min(used), F.max(used)
    return flow.groupBy(*VIDEO).agg(
        F.when(lo.isNull(), "none").when(lo == hi, lo).otherwise("mixed").alias("method"))


def trace_drift(track: DataFrame, trace: DataFrame) -> DataFrame:
    """Distance between the flow trace and the track on shared frames."""
    return track.join(trace, [*VIDEO, FRAME]).withColumn("drift", distance("cx", "cy", "trace_x", "trace_y"))


def drift_by_block(track: DataFrame, trace: DataFrame, *, block: int = 50, jump: float = 30.0, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Tumbling blocks of the trace: drift statistics, interpolated frames and jumps inside the block."""
    stepped = halo_window(track, lambda w: {"_px": F.lag("cx").over(w), "_py": F.lag("cy").over(w)}, before=1, chunk=chunk)
    first = trace.groupBy(*VIDEO).agg(F.min(FRAME).alias("_t0"))
    rows = trace_drift(stepped, trace).join(first, list(VIDEO))
    offset = F.col(FRAME) - F.col("_t0")
    inside = (offset % block) > 0
    return rows.withColumn("block", F.floor(offset / block)).groupBy(*VIDEO, "block").agg(
        F.avg("drift").alias("mean_drift"), F.percentile("drift", 0.5).alias("median_drift"), F.max("drift").alias("max_drift"),
        F.count_if("interpolated").alias("n_interpolated"),
        F.count_if(inside & (distance("cx", "cy", "_px", "_py") > jump)).alias("n_jumps"))


def displacement_smoothness(points: DataFrame, x: str, y: str, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Mean, deviation and maximum of the displacement between consecutive frames."""
    stepped = halo_window(points, lambda w: {"_px": F.lag(x).over(w), "_py": F.lag(y).over(w), "_pf": F.lag(FRAME).over(w)}, before=1, chunk=chunk)
    step = stepped.where(F.col(FRAME) == F.col("_pf") + 1).withColumn("_d", distance(x, y, "_px", "_py"))
    return step.groupBy(*VIDEO).agg(F.avg("_d").alias("mean"), F.stddev_pop("_d").alias("std"), F.max("_d").alias("max"))


def drift_summary(track: DataFrame, trace: DataFrame) -> DataFrame:
    out = distribution(trace_drift(track, trace), "drift", probs={"median": 0.5, "p90": 0.9})
    return out.select(*VIDEO, "n", "mean", "median", "p90", "max")


def merge_traces(first: DataFrame, second: DataFrame) -> DataFrame:
    """First trace, averaged with the second where both have the frame."""
    other = second.select(*VIDEO, FRAME, F.col("trace_x").alias("_x"), F.col("trace_y").alias("_y"))
    mix = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise((F.col(a) + F.col(b)) / 2).alias(a)
    return first.join(other, [*VIDEO, FRAME], "left").select(*VIDEO, FRAME, mix("trace_x", "_x"), mix("trace_y", "_y"))


def concat_traces(backward: DataFrame, forward: DataFrame, seed: DataFrame) -> DataFrame:
    """Backward trace before the seed frame and forward trace from it, without a second seed row."""
    at = seed.select(*VIDEO, F.col("seed_frame"))
    head = backward.join(at, list(VIDEO)).where(F.col(FRAME) < F.col("seed_frame"))
    tail = forward.join(at, list(VIDEO)).where(F.col(FRAME) >= F.col("seed_frame"))
    return head.unionByName(tail).drop("seed_frame")
