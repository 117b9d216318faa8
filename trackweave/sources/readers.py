"""Readers: one JSON document or CSV file per video, in a folder named after the video.

All readers declare their schema, take many videos at once and add a `video` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.geometry import first_present
from trackweave.functions.text import frame_no_from_file, score_from_name
from trackweave.sources import schemas as sc
from trackweave.sources.split_json import FILE, SPLIT_BYTES, longest_file, read_elements


def video_of_path(path: Column) -> Column:
    """Name of the folder a file lies in (`name` or `video=name`)."""
    folder = F.regexp_extract(path, r"(?:video=)?([^/=]+)/[^/]+$", 1)
    return F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select(video_of_path(F.col("_metadata.file_path")).alias("video"), "*")


def _frames(spark: SparkSession, path: str, schema: str, column: str = "frames", *keep: str) -> DataFrame:
    """video, header fields, pos and f: a row per array element.

    Where a document is longer than `SPLIT_BYTES` its elements are read by many tasks, otherwise a document by one; the rows are the same.
    """
    if longest_file(spark, path) > SPLIT_BYTES:
        rows = read_elements(spark, path, schema, column, keep)
        return rows.select(video_of_path(F.col(FILE)).alias("video"), *keep, "pos", "f")
    return _documents(spark, path, schema).select("video", *keep, F.posexplode(column).alias("pos", "f"))


def _box(source: Column, prefix: str = "") -> list[Column]:
    return [F.get(source, F.lit(i)).cast("long").alias(f"{prefix}{name}") for i, name in enumerate(("x1", "y1", "x2", "y2"))]


def read_detections(spark: SparkSession, path: str, *, tracked_only: bool = False) -> DataFrame:
    """Persons of every frame; frames without persons give one row with a null `det_no`."""
    rows = _frames(spark, path, sc.DETECTION_MANIFEST)
    people = rows.select("video", "pos", "f", F.posexplode_outer("f.persons").alias("det_no", "p"))
    out = people.select(
        "video", F.coalesce("f.frame_id", "pos").alias("frame_id"), frame_no_from_file(F.col("f.frame_file")).alias("frame_no"), "det_no",
        F.col("p.track_id").alias("track_id"), *_box(F.col("p.bbox")), F.col("p.confidence").alias("confidence"), F.col("p.area").alias("area"))
    return out.where("det_no IS NOT NULL AND track_id IS NOT NULL") if tracked_only else out


def read_frame_selection(spark: SparkSession, path: str) -> DataFrame:
    """The frame-level choice of the detector."""
    rows = _frames(spark, path, sc.DETECTION_MANIFEST)
    return rows.select(
        "video", F.coalesce("f.frame_id", "pos").alias("frame_id"), "f.frame_file", F.coalesce("f.detected", F.lit(False)).alias("detected"),
        *_box(F.col("f.bbox")), *_box(F.col("f.bbox_padded"), "crop_"), "f.confidence", "f.track_id", F.size(F.coalesce("f.persons", F.array())).alias("n_persons"))


def read_track(spark: SparkSession, path: str, *, on_bad: str = "skip") -> DataFrame:
    """One row per frame with a box of four numbers.

    Rows whose file name has no number are skipped or, with `on_bad="frame_id"`, use the frame id.
    """
    if on_bad not in ("skip", "frame_id"):
        raise ValueError(f"unknown on_bad {on_bad!r}")
    rows = _frames(spark, path, sc.TRACK_MANIFEST).where(F.size("f.bbox") == 4)
    frame_id = F.coalesce("f.frame_id", "pos")
    number = frame_no_from_file(F.col("f.frame_file"))
    out = rows.select(
        "video", frame_id.alias("frame_id"), (F.coalesce(number, frame_id) if on_bad == "frame_id" else number).alias("frame_no"),
        *_box(F.col("f.bbox")), *_box(F.col("f.bbox_padded"), "crop_"), "f.confidence", "f.track_id", "f.detected", "f.interpolated",
        F.coalesce("f.of_synthetic", F.lit(False)).alias("of_synthetic"), "f.velocity", F.col("f.speed_px_per_frame").alias("speed"))
    return out.where("frame_no IS NOT NULL").withColumns({"cx": (F.col("x1") + F.col("x2")) / 2.0, "cy": (F.col("y1") + F.col("y2")) / 2.0})


def read_track_runs(spark: SparkSession, path: str) -> DataFrame:
    """The header of every track document."""
    return _documents(spark, path, sc.TRACK_MANIFEST).select(
        "video", "n_frames", "selected_track_id", "merged_tracks", "track_score", "identity_guard_rejections", "velocity_stats", "candidate_pool_stats")


def read_velocity(spark: SparkSession, path: str) -> DataFrame:
    rows = _frames(spark, path, sc.VELOCITY_MANIFEST)
    return rows.select("video", frame_no_from_file(F.col("f.frame_file")).alias("frame_no"), "f.*")


def read_velocity_runs(spark: SparkSession, path: str) -> DataFrame:
    """The summary of every velocity document."""
    return _documents(spark, path, sc.VELOCITY_MANIFEST).select("video", "n_frames", "summary.*")


def read_jumps(spark: SparkSession, path: str) -> DataFrame:
    rows = _frames(spark, path, sc.VELOCITY_MANIFEST, "jumps")
    return rows.select("video", F.col("pos").cast("long").alias("jump_id"), F.col("f.start_frame_id").alias("start_frame"), F.col("f.end_frame_id").alias("end_frame"),
                       F.col("f.peak_frame_id").alias("peak_frame"), "f.airtime_frames", F.col("f.peak_speed_px_per_frame").alias("peak_speed"))


def read_poses_2d(spark: SparkSession, path: str) -> DataFrame:
    """`kp` array of (x, y, conf); the frame id defaults to the position."""
    rows = _frames(spark, path, sc.POSE_2D_MANIFEST, "frames", "keypoint_names")
    kp = F.transform("f.keypoints", lambda k: F.struct(k[0].alias("x"), k[1].alias("y"), k[2].alias("conf")))
    return rows.select("video", F.coalesce("f.frame_id", "pos").alias("frame_id"), F.coalesce("keypoint_names", F.array()).alias("names"), kp.alias("kp"), "f.bbox")


def read_poses_3d(spark: SparkSession, path: str) -> DataFrame:
    rows = _frames(spark, path, sc.POSE_3D_MANIFEST)
    pose = F.transform("f.keypoints_3d", lambda k: F.struct(k[0].alias("x"), k[1].alias("y"), k[2].alias("z")))
    return rows.select("video", F.col("pos").cast("long").alias("frame_id"), pose.alias("pose"))


def read_projection(spark: SparkSession, path: str) -> DataFrame:
    """Map positions; a document without them is an error."""
    docs = _documents(spark, path, sc.PROJECTION_MANIFEST)
    checked = F.coalesce("projected_positions", F.raise_error(F.concat(F.lit("projected_positions missing for "), "video")).cast(
        docs.schema["projected_positions"].dataType))
    return docs.select("video", F.explode(checked).alias("f")).select("video", F.col("f.frame_id").alias("frame_no"), "f.venue_x", "f.venue_y")


def read_flow_trace(spark: SparkSession, path: str) -> DataFrame:
    return _frames(spark, path, sc.TRACE_MANIFEST, "trace").select("video", "f.idx", "f.x", "f.y", "f.ok")


def read_start_region(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, sc.START_REGION)


def read_frames_meta(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, sc.FRAMES_META)


def with_fps(videos: DataFrame, meta: DataFrame, default: float = 30.0) -> DataFrame:
    """Frame rate of each video: effective, else source, else the default; videos need no meta row."""
    m = meta.select("video", "effective_fps", "source_fps")
    return videos.join(m, "video", "left").withColumn("fps", first_present("effective_fps", "source_fps", F.lit(default))).drop("effective_fps", "source_fps")


def read_gt_centers(spark: SparkSession, path: str) -> DataFrame:
    """Annotated centres; `#` lines are comments and the last line of a frame wins."""
    rows = spark.read.schema(sc.GT_CENTERS).option("comment", "#").option("ignoreLeadingWhiteSpace", True).csv(path)
    order = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    rows = rows.select(video_of_path(F.col("_metadata.file_path")).alias("video"), "*", order.alias("_at")).where("frame_no IS NOT NULL")
    last = rows.groupBy("video", "frame_no").agg(F.max(F.struct("_at", "track_id", "center_x", "center_y")).alias("r"))
    return last.select("video", "frame_no", "r.track_id", "r.center_x", "r.center_y")


def read_gt_jumps(spark: SparkSession, path: str) -> DataFrame:
    """Annotated jumps with end after start; source frames default to the frames."""
    rows = spark.read.schema(sc.GT_JUMPS).option("header", True).option("enforceSchema", True).csv(path)
    rows = rows.select(video_of_path(F.col("_metadata.file_path")).alias("video"), "*").where("end_frame > start_frame")
    return rows.withColumns({
        "start_source_frame": F.coalesce("start_source_frame", "start_frame"), "end_source_frame": F.coalesce("end_source_frame", "end_frame")})


def read_gt_venue(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """Annotated map positions; malformed lines are dropped or, when strict, an error."""
    reader = spark.read.option("comment", "#").option("ignoreLeadingWhiteSpace", True)
    if strict:
        rows = reader.schema(sc.GT_VENUE).option("mode", "FAILFAST").csv(path)
    else:
        rows = reader.schema(sc.GT_VENUE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").csv(path)
        rows = rows.where("_bad IS NULL AND frame_no IS NOT NULL AND venue_x IS NOT NULL AND venue_y IS NOT NULL")
    return rows.select(video_of_path(F.col("_metadata.file_path")).alias("video"), "frame_no", "venue_x", "venue_y")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Videos that have a file matching the glob `path`; only names are listed, nothing is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(video_of_path(F.col("path")).alias("video")).distinct()


def catalogue(spark: SparkSession, path: str, category: str) -> DataFrame:
    """Scored videos of a category that have a pose file, best score first."""
    names = discover(spark, path).where(F.col("video").startswith(category))
    return names.withColumn("score", score_from_name("video")).where("score IS NOT NULL AND score <> 0").orderBy(F.col("score").desc())
