"""Joins, set operations and slices of per-video tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.series import CHUNK_FRAMES, FRAME, VIDEO, with_position


def sampled_frames(videos: DataFrame, *, target_fps: float | None, trim_start: float = 0.0, trim_end: float = 0.0, cap: int | None = None, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Source frames that are extracted: trimmed by seconds, every `step`-th by absolute number, capped.

    `videos` has source_fps and total_frames.  Also gives the dense frame_id of each.
    """
    fps, total = F.col("source_fps"), F.col("total_frames")
    start = F.floor(F.lit(trim_start) * fps).cast("long")
    end = F.least(F.greatest(start + 1, F.floor((total / fps - F.lit(trim_end)) * fps).cast("long")), total)
    step = F.lit(1).cast("long")
    if target_fps is not None:
        step = F.when(fps > target_fps, F.greatest(F.lit(1), F.rint(fps / target_fps).cast("long"))).otherwise(step)
    v = videos.withColumns({"_start": start, "_end": end, "step": step}).withColumn("_i0", F.ceil(F.col("_start") / F.col("step")))
    v = v.withColumn("_n", F.floor((F.col("_end") - 1) / F.col("step")) - F.col("_i0") + 1).where("_n > 0")
    if cap:
        v = v.withColumn("_n", F.least("_n", F.lit(cap)))
    blocks = v.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))))
    lo = F.col("_b") * chunk
    ids = blocks.withColumn(FRAME, F.explode(F.sequence(lo, F.least(lo + chunk, F.col("_n")) - 1)))
    return ids.select(*VIDEO, FRAME, ((F.col("_i0") + F.col(FRAME)) * F.col("step")).alias("frame_no"), "step", (fps / F.col("step")).alias("effective_fps"))


def every_nth(rows: DataFrame, n: int, *, flag: str = "kept", chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Flag every n-th row of a video by position, the first included."""
    return with_position(rows, "_i", chunk=chunk).withColumn(flag, F.col("_i") % n == 0).drop("_i")


def first_rows(rows: DataFrame, n: int, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """The first n rows of each video."""
    return with_position(rows, "_i", chunk=chunk).where(F.col("_i") < n).drop("_i")


def first_videos(videos: DataFrame, n: int) -> DataFrame:
    return videos.orderBy(*VIDEO).limit(n)


def frame_slice(rows: DataFrame, *, between: tuple[int, int] | None = None, frames: Sequence[int] | None = None) -> DataFrame:
    """Rows of a frame range or of listed frames."""
    keep = F.lit(False)
    if between is not None:
        keep = keep | F.col(FRAME).between(*between)
    if frames is not None:
        keep = keep | F.col(FRAME).isin(*frames)
    return rows.where(keep)


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items without a result yet: (video, stage) pairs, or tracked videos without annotation."""
    return wanted.join(done.select(*keys), list(keys), "left_anti")


def prefer(first: DataFrame, second: DataFrame, columns: Sequence[str], keys: Sequence[str] = (*VIDEO, FRAME)) -> DataFrame:
    """Rows of `second` with the columns of `first` where it has the key."""
    mine = first.select(*keys, F.lit(True).alias("_has"), *[F.col(c).alias(f"_1_{c}") for c in columns])
    joined = second.select(*keys, *columns).join(mine, list(keys), "left")
    picked = [F.when(F.col("_has"), F.col(f"_1_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return joined.select(*keys, *picked, F.coalesce("_has", F.lit(False)).alias("from_first"))


def zip_by_position(left: DataFrame, right: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Rows of both sides paired by their position in the video, cut at the shorter side."""
    a = with_position(left, "_i", chunk=chunk)
    b = with_position(right, "_i", chunk=chunk)
    names = [c for c in b.columns if c not in (*VIDEO, "_i")]
    b = b.select(*VIDEO, "_i", *[F.col(c).alias(f"right_{c}") for c in names])
    return a.join(b, [*VIDEO, "_i"]).withColumnRenamed("_i", "position")


def flag_selected(detections: DataFrame, selected: DataFrame, flag: str = "is_selected") -> DataFrame:
    """Flag detections whose track id is among the selected ones of their video."""
    mine = selected.select(*VIDEO, "track_id").distinct().withColumn("_s", F.lit(True))
    return detections.join(mine, [*VIDEO, "track_id"], "left").withColumn(flag, F.coalesce("_s", F.lit(False))).drop("_s")


def flag_merged(detections: DataFrame, runs: DataFrame, flag: str = "is_selected") -> DataFrame:
    """The same from the `merged_tracks` list of the run headers."""
    hit = F.array_contains(F.coalesce("merged_tracks", F.array().cast("array<bigint>")), F.col("track_id"))
    return detections.join(runs.select("video", "merged_tracks"), "video", "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop("merged_tracks")


def common_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = (*VIDEO, FRAME)) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def only_in(left: DataFrame, right: DataFrame, keys: Sequence[str] = (*VIDEO, FRAME)) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")


def upsert_annotations(auto: DataFrame, existing: DataFrame, *, tolerance: float = 0.5) -> DataFrame:
    """Existing annotations over seeds from the tracker; `corrected` when moved beyond the tolerance
    on either axis or not seeded at all."""
    e = existing.select(*VIDEO, FRAME, F.col("center_x").alias("_x"), F.col("center_y").alias("_y"))
    both = auto.select(*VIDEO, FRAME, "center_x", "center_y").join(e, [*VIDEO, FRAME], "full")
    moved = (F.abs(F.col("_x") - F.col("center_x")) > tolerance) | (F.abs(F.col("_y") - F.col("center_y")) > tolerance)
    corrected = F.col("_x").isNotNull() & (F.col("center_x").isNull() | moved)
    return both.select(
        *VIDEO, FRAME, F.coalesce("_x", "center_x").alias("center_x"), F.coalesce("_y", "center_y").alias("center_y"), F.coalesce(corrected, F.lit(False)).alias("corrected"))
