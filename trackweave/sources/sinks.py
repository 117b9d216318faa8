"""Writers: partitioned tables, JSON documents per video, annotation CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.geometry import half_even
from trackweave.functions.text import one_decimal
from trackweave.operators.series import with_position


def write_table(df: DataFrame, path: str, *, by: Sequence[str] = ("video",), mode: str = "overwrite") -> None:
    """Parquet, one folder per key; only the folders present in `df` are replaced.

    Rows are gathered by key first, in partitions of even size, so a folder gets few files and a long video several.
    """
    df.hint("rebalance", *by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """Metric rows of a run.  The rows of its configurations replace earlier ones, so a run that is tried again leaves no doubles."""
    write_table(df, path, by=("config",))


def write_documents(rows: DataFrame, record: Column, path: str, *, order: str, header: DataFrame | None = None, array: str = "frames") -> None:
    """One JSON document per video: header fields, then one array element per row.

    Elements are written as lines in order, so a document is streamed to its file and a long video
    is never held as one value.  `header` has one row per video with further top-level columns.
    """
    bounds = rows.groupBy("video").agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    body = rows.select("video", F.col(order).alias("_at"), F.to_json(record, {"ignoreNullFields": "false"}).alias("_line"))
    body = body.join(bounds, "video")
    if header is None:
        top, joined = F.lit("{"), body
    else:
        fields = [c for c in header.columns if c != "video"]
        # a video of the header without rows still gets its empty document
        joined = header.join(body, "video", "left")
        top = F.concat(F.regexp_replace(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), r"\}$", ""), F.lit(","))
    empty = F.col("_at").isNull()
    opened = F.when(empty | (F.col("_at") == F.col("_first")), F.concat(top, F.lit(f'"{array}":[')))
    line = F.when(~empty, F.concat(F.when(F.col("_at") == F.col("_first"), "").otherwise(","), F.col("_line")))
    closed = F.when(empty | (F.col("_at") == F.col("_last")), F.lit("]}"))
    _write_lines(joined.select("video", "_at", F.array(opened, line, closed).alias("_lines")), path)


def write_records(rows: DataFrame, path: str) -> None:
    """One flat JSON document per video from one row per video."""
    fields = F.to_json(F.struct(*[c for c in rows.columns if c != "video"]), {"ignoreNullFields": "false"})
    _write_lines(rows.select("video", F.lit(0).alias("_at"), F.array(fields).alias("_lines")), path)


def run_header(frames: DataFrame, ranked: DataFrame, *, rejections: DataFrame | None = None, conflicts: DataFrame | None = None, settings: dict[str, Column] | None = None) -> DataFrame:
    """Header of the track document: what was selected and how the run went, one row per video of `frames` (video, vx, vy per frame).

    `ranked` has the selected tracks (track_id, score, rank); `rejections` a count per video, `conflicts` the conflict summary.
    `merged_tracks` is null for a single track; statistics of a run without velocities are null.
    """
    moving = F.col("vx").isNotNull()
    speed = F.when(moving, F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    per = frames.groupBy("video").agg(F.count(F.lit(1)).alias("n_frames"), F.avg(speed).alias("_mean"), F.max(speed).alias("_max"), F.avg("vy").alias("_vy"))
    stats = F.when(F.col("_mean").isNotNull(), F.struct(half_even("_mean", 2).alias("mean_speed"), half_even("_max", 2).alias("max_speed"), half_even("_vy", 2).alias("mean_vy")))
    chosen = ranked.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("rank", "track_id", "score"))).alias("_t"))
    out = per.join(chosen, "video", "left")
    ids = F.transform("_t", lambda t: t["track_id"])
    columns = {
        "selected_track_id": F.get(ids, F.lit(0)), "merged_tracks": F.when(F.size("_t") > 1, ids), "track_score": half_even(F.get("_t", F.lit(0))["score"], 4), "velocity_stats": stats}
    if rejections is not None:
        out = out.join(rejections.select("video", F.col("rejections").alias("identity_guard_rejections")), "video", "left")
        columns["identity_guard_rejections"] = F.coalesce("identity_guard_rejections", F.lit(0).cast("long"))
    if conflicts is not None:
        out = out.join(conflicts.select("video", F.struct("conflict_frames", "of_available", "avg_margin").alias("candidate_pool_stats")), "video", "left")
        columns["candidate_pool_stats"] = F.col("candidate_pool_stats")
    columns |= settings or {}
    return out.select("video", "n_frames", *[c.alias(k) for k, c in columns.items()])


def velocity_header(velocity: DataFrame, jumps: DataFrame) -> DataFrame:
    """Header of the velocity document: summary and jumps in order of their start, one row per video.  A video has few jumps beside its frames."""
    per = velocity.groupBy("video").agg(F.count(F.lit(1)).alias("n_frames"), half_even(F.avg("speed"), 4).alias("_mean"), half_even(F.max("speed"), 4).alias("_max"))
    jump = F.struct(
        F.col("start_frame").alias("start_frame_id"), F.col("end_frame").alias("end_frame_id"), F.col("peak_frame").alias("peak_frame_id"), "airtime_frames",
        half_even("peak_speed", 4).alias("peak_speed_px_per_frame"))
    found = jumps.groupBy("video").agg(F.sort_array(F.collect_list(jump)).alias("jumps"))
    out = per.join(found, "video", "left")
    return out.select("video", "n_frames", F.struct(F.col("_mean").alias("mean_speed"), F.col("_max").alias("max_speed"), F.coalesce(F.size("jumps"), F.lit(0)).alias("n_jumps")).alias("summary"),
                      F.coalesce("jumps", F.array().cast(found.schema["jumps"].dataType)).alias("jumps"))


def _write_lines(rows: DataFrame, path: str) -> None:
    """One text file per video from rows of lines, ordered by `_at` and place in the row.

    Rows are dealt by a hash of the name, not by the name: a join on the name would count as that partitioning, and where Spark turns
    such a join into a broadcast while it runs, a video would be left in many tasks and files.
    """
    lines = rows.select("video", "_at", F.posexplode("_lines").alias("_n", "value")).where("value IS NOT NULL")
    lines = lines.repartition(F.xxhash64("video")).sortWithinPartitions("video", "_at", "_n")
    lines.select("video", "value").write.mode("overwrite").partitionBy("video").text(path)


def track_record() -> Column:
    """A frame of the track manifest, rounded as it is written."""
    box = lambda p: F.array(*[F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")])
    has_velocity = F.col("vx").isNotNull()
    return F.struct(
        "frame_id", "frame_file", "detected", "interpolated", "of_synthetic", box("").alias("bbox"), box("crop_").alias("bbox_padded"),
        half_even("confidence", 4).alias("confidence"), F.lit(-1).alias("track_id"),
        F.when(has_velocity, F.array(half_even("vx", 2), half_even("vy", 2))).alias("velocity"), half_even("speed", 2).alias("speed_px_per_frame"))


def velocity_record() -> Column:
    r = lambda c, n, digits=4: half_even(c, digits).alias(n)
    return F.struct(
        "frame_id", "frame_file", r("center_x", "center_x", 2), r("center_y", "center_y", 2), r("flow_dx", "camera_flow_dx"), r("flow_dy", "camera_flow_dy"),
        r("vel_dx", "athlete_vel_dx"), r("vel_dy", "athlete_vel_dy"), r("comp_dx", "compensated_vel_dx"), r("comp_dy", "compensated_vel_dy"),
        r("speed", "speed_raw"), r("speed_smoothed", "speed_smoothed"), r("acceleration", "acceleration"), "in_jump")


def projection_record() -> Column:
    return F.struct(F.col("frame_no").alias("frame_id"), "venue_x", "venue_y")


def pose_record(column: str, fields: Sequence[str], name: str) -> Column:
    return F.struct("frame_id", F.transform(column, lambda p: F.array(*[p[f] for f in fields])).alias(name))


def centre_rows(annotations: DataFrame) -> DataFrame:
    """Annotated centres as text columns with one decimal, ids renumbered to 1."""
    return annotations.select("video", F.col("frame_no").alias("frame_id"), F.lit(1).alias("track_id"), one_decimal("center_x").alias("center_x"), one_decimal("center_y").alias("center_y"))


def venue_rows(annotations: DataFrame) -> DataFrame:
    return annotations.select("video", F.col("frame_no").alias("frame_id"), one_decimal("venue_x").alias("venue_x"), one_decimal("venue_y").alias("venue_y"))


def jump_rows(annotations: DataFrame) -> DataFrame:
    """Annotated jumps renumbered from 1 in order of their start."""
    placed = with_position(annotations, "_i", keys=("video",), order=("start_frame", "end_frame"))
    return placed.select("video", (F.col("_i") + 1).alias("jump_id"), "start_frame", "end_frame", "start_source_frame", "end_source_frame")


def write_annotations(rows: DataFrame, path: str, *, order: str = "frame_id", comment_header: bool = True) -> None:
    """One CSV file per video, sorted, its header as a comment line."""
    columns = [c for c in rows.columns if c != "video"]
    title = ("# " if comment_header else "") + ",".join(columns)
    first = rows.groupBy("video").agg(F.min(order).alias("_first"))
    text = rows.select("video", F.col(order).alias("_at"), F.concat_ws(",", *[F.col(c).cast("string") for c in columns]).alias("_line")).join(first, "video")
    head = F.when(F.col("_at") == F.col("_first"), F.lit(title))
    _write_lines(text.select("video", "_at", F.array(head, F.col("_line")).alias("_lines")), path)


def stub_rows(expected: DataFrame, present: DataFrame, reason: str) -> DataFrame:
    """Videos without the needed input: zero frames and the reason."""
    missing = expected.select("video").distinct().join(present.select("video").distinct(), "video", "left_anti")
    return missing.select("video", F.lit(0).cast("long").alias("n_frames"), F.lit(reason).alias("reason"))
