"""Detections to one smoothed box per frame, for all videos in one program.

Stage results that several later steps read are written once to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.geometry import with_box_geometry
from trackweave.operators import sequential as sq
from trackweave.operators import tracks as tr
from trackweave.operators.gapfill import BOX, fill_linear, frame_spine, with_crop
from trackweave.operators.series import CHUNK_FRAMES, FRAME, VIDEO
from trackweave.session import materialize


@dataclass(frozen=True)
class TrackParams:
    selection: tr.SelectionParams = field(default_factory=lambda: tr.SelectionParams(
        threshold=0.6, adaptive=True, threshold_low=0.5, threshold_high=0.6, min_overlap_ratio=0.55))
    merge: bool = True
    resolver: sq.ResolverParams = field(default_factory=sq.ResolverParams)
    trace: sq.TraceParams = field(default_factory=sq.TraceParams)
    bidirectional: bool = False
    guard: bool = False
    guard_max_jump: float = 100.0
    guard_trace: sq.TraceParams = field(default_factory=lambda: sq.TraceParams(
        mode="selected", interval=50, min_confidence=0.5, max_drift=200.0))
    flow_fill: bool = True
    fill: sq.FlowFillParams = field(default_factory=sq.FlowFillParams)
    smooth_window: int = 5
    kalman: sq.KalmanParams = field(default_factory=sq.KalmanParams)
    crop_width: int = 192
    crop_height: int = 320
    padding: float = 0.15


def videos_without_tracks(detections: DataFrame) -> DataFrame:
    has = detections.groupBy(*VIDEO).agg(F.max(F.col("track_id").isNotNull()).alias("_has"))
    return has.where(~F.col("_has")).select(*VIDEO)


def passthrough(detections: DataFrame, videos: DataFrame, *, strategy: str = "largest") -> DataFrame:
    """Without track ids: the picked person where there is one, else the whole frame with confidence 0."""
    picked = tr.pick_person(detections.join(videos.select(*VIDEO, "img_w", "img_h"), list(VIDEO)), strategy)
    spine = frame_spine(videos)
    boxes = picked.select(*VIDEO, FRAME, *BOX, "confidence", F.lit(True).alias("_seen"))
    rows = spine.join(boxes, [*VIDEO, FRAME], "left")
    whole = {"x1": F.lit(0).cast("long"), "y1": F.lit(0).cast("long"), "x2": F.col("img_w"), "y2": F.col("img_h")}
    return rows.select(
        *VIDEO, FRAME, *[F.coalesce(c, v).alias(c) for c, v in whole.items()], F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("_seen", F.lit(False)).alias("detected"), F.lit(False).alias("interpolated"))


def choose_observations(
    detections: DataFrame, videos: DataFrame, flow: DataFrame | None, params: TrackParams = TrackParams(), *, chunk: int = CHUNK_FRAMES,
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """One observation per frame, the guiding trace (with flow) and the track selection."""
    scored = tr.track_scores(detections, videos, params.selection)
    selection = materialize(tr.select_tracks(tr.competing_tracks(scored), params.selection))
    ranked = tr.rank_tracks(selection)
    if not params.merge:
        best = ranked.where("rank = 1").select(*VIDEO, "track_id")
        single = detections.where(F.col("track_id").isNotNull()).join(best, [*VIDEO, "track_id"], "left_semi")
        one = single.groupBy(*VIDEO, FRAME).agg(F.max(F.struct("det_no", *BOX, "confidence", "track_id")).alias("b")).select(*VIDEO, FRAME, "b.*")
        return one.withColumn("of_synthetic", F.lit(False)), None, selection
    order = ranked.select(*VIDEO, "track_id", F.col("rank").alias("order"))
    pool = materialize(tr.candidates(detections, selection, params.selection.min_confidence).join(order, [*VIDEO, "track_id"]))
    trace = None
    if flow is not None:
        first = with_box_geometry(pool.where("order = 1")).groupBy(*VIDEO).agg(F.min(F.struct(FRAME, "det_no", "cx", "cy")).alias("b"))
        seed = first.select(*VIDEO, F.col(f"b.{FRAME}").alias("seed_frame"), F.col("b.cx").alias("seed_x"), F.col("b.cy").alias("seed_y"))
        spine = frame_spine(videos, chunk=chunk)
        trace = sq.flow_trace(spine, flow, seed, pool, params.trace)
        if params.bidirectional:
            trace = sq.bidirectional_trace(spine, flow, trace, pool)
        trace = materialize(trace)
    resolved = sq.resolve_conflicts(sq.candidate_frames(pool, trace, videos, params.resolver), params.resolver, chunk=chunk)
    return materialize(resolved), trace, selection


def guard(observations: DataFrame, videos: DataFrame, flow: DataFrame | None, params: TrackParams, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Drop observations that the identity guard rejects."""
    trace = None
    if flow is not None:
        o = with_box_geometry(observations)
        first = o.groupBy(*VIDEO).agg(F.min(F.struct(FRAME, "cx", "cy")).alias("b"))
        seed = first.select(*VIDEO, F.col(f"b.{FRAME}").alias("seed_frame"), F.col("b.cx").alias("seed_x"), F.col("b.cy").alias("seed_y"))
        trace = sq.flow_trace(frame_spine(videos, chunk=chunk), flow, seed, observations.withColumn("det_no", F.coalesce("det_no", F.lit(0).cast("long"))), params.guard_trace)
    checked = sq.guard_identity(observations, trace, max_jump=params.guard_max_jump)
    return observations.join(checked.where(~F.col("accepted")).select(*VIDEO, FRAME), [*VIDEO, FRAME], "left_anti")


def track_videos(
    detections: DataFrame, videos: DataFrame, flow: DataFrame | None = None, params: TrackParams = TrackParams(), *, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Selection, conflict resolution, guard, gap filling, smoothing and crop windows.

    Exactly one row per frame: of every video that has a track, and, from `passthrough` and without velocities, of
    every video none of whose detections has a track id.
    """
    observations, _, _ = choose_observations(detections, videos, flow, params, chunk=chunk)
    if params.guard:
        observations = guard(observations, videos, flow, params, chunk=chunk)
    if flow is not None and params.flow_fill:
        filled = sq.fill_by_flow(observations, videos, flow, params.fill, chunk=chunk)
    else:
        filled = fill_linear(observations, videos, chunk=chunk).withColumns(
            {"flow_vx": F.lit(None).cast("double"), "flow_vy": F.lit(None).cast("double")})
    still = {"vx": F.lit(None).cast("double"), "vy": F.lit(None).cast("double")}
    if params.smooth_window <= 0:
        smooth = filled.withColumns(still)
    elif flow is not None and params.flow_fill:
        # the Kalman smoother is for videos with flow velocities; one without a gap to fill has none
        filled = materialize(filled)
        moving = filled.where("flow_vx IS NOT NULL").select(*VIDEO).distinct()
        by_flow = filled.join(moving, list(VIDEO), "left_semi")
        moved = sq.smooth_kalman(by_flow, params.kalman)
        plain = sq.smooth_ema(filled.join(moving, list(VIDEO), "left_anti"), params.smooth_window).withColumns(still)
        smooth = by_flow.drop(*BOX).join(moved, [*VIDEO, FRAME]).unionByName(plain)
    else:
        smooth = sq.smooth_ema(filled, params.smooth_window).withColumns(still)
    has_ids = detections.where(F.col("track_id").isNotNull()).select(*VIDEO).distinct()
    bare = passthrough(detections, videos.join(has_ids, list(VIDEO), "left_anti"))
    smooth = smooth.unionByName(bare.withColumns(still), allowMissingColumns=True)
    cropped = with_crop(smooth, width=params.crop_width, height=params.crop_height, padding=params.padding)
    tracked = cropped.select(
        *VIDEO, FRAME, *BOX, *[F.col(f"crop_{c}").cast("long").alias(f"crop_{c}") for c in BOX], "confidence", "detected", "interpolated",
        F.coalesce("of_synthetic", F.lit(False)).alias("of_synthetic"), "vx", "vy", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("speed"))
    return tracked
