"""The tracking program over videos of different kinds: without track ids, without gaps, with gaps filled by flow."""

import pytest
from pyspark.sql import functions as F

from trackweave.operators.tracks import VIDEO
from trackweave.plans import tracking as plan

N = 40


@pytest.fixture(scope="module")
def tables(spark):
    frames = spark.range(3).select(F.col("id").alias("video_id")).crossJoin(spark.range(N).select(F.col("id").alias("frame_id")))
    moved = frames.withColumns({"x1": 100 + 4 * F.col("frame_id") + F.col("frame_id") % 3, "y1": F.lit(200) + F.col("frame_id") % 2})
    detections = moved.withColumns({
        "x2": F.col("x1") + 60, "y2": F.col("y1") + 150, "det_no": F.lit(0).cast("long"), "confidence": F.lit(0.9),
        "track_id": F.when(F.col("video_id") > 0, F.lit(1).cast("long"))})
    # video 0 has no ids, video 1 no gap, video 2 a gap
    detections = detections.where("NOT (video_id = 2 AND frame_id BETWEEN 15 AND 22)")
    videos = spark.range(3).select(F.col("id").alias("video_id"), F.lit(N).cast("long").alias("n_frames"), F.lit(1280).cast("long").alias("img_w"), F.lit(720).cast("long").alias("img_h"))
    flow = frames.withColumns({"dx": F.lit(4.0), "dy": F.lit(0.0), "confidence": F.lit(0.9)})
    return detections, videos, flow


def test_every_video_has_every_frame(tables):
    detections, videos, _ = tables
    out = plan.track_videos(detections, videos)
    assert {tuple(r) for r in out.groupBy(*VIDEO).agg(F.count("*"), F.count("vx")).collect()} == {(v, N, 0) for v in range(3)}
    bare = out.where("video_id = 0").orderBy("frame_id").collect()
    assert all(r.detected and not r.interpolated and r.crop_x1 is not None for r in bare)
    assert [r.x1 for r in bare] == [100 + 4 * i + i % 3 for i in range(N)]
