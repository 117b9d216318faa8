"""Readers on hand-written files with the odd rows real ones have."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackweave.operators.tables import flag_merged
from trackweave.plans.tracking import passthrough, videos_without_tracks
from trackweave.sources import readers as rd
from trackweave.sources import sinks as sk


def put(root, video, name, content):
    folder = root / video
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


@pytest.fixture
def root(tmp_path):
    return tmp_path


def test_detection_manifest(spark, root):
    person = {"bbox": [1, 2, 11, 22], "confidence": 0.5, "area": 200, "track_id": 7}
    put(root, "run a+b", "segmentation.json", {"frames": [
        {"frame_id": 0, "frame_file": "frame_000150.jpg", "detected": True, "bbox": [1, 2, 11, 22], "bbox_padded": [0, 0, 12, 24], "persons": [person, {**person, "track_id": None}]},
        {"frame_id": 1, "frame_file": "cover.jpg", "detected": False, "persons": []}, {"frame_file": "frame_000152.png", "detected": False}]})
    rows = rd.read_detections(spark, f"{root}/*/segmentation.json").orderBy("frame_id", "det_no").collect()
    assert [(r.video, r.frame_id, r.frame_no, r.track_id, r.x2) for r in rows] == [
        ("run a+b", 0, 150, 7, 11), ("run a+b", 0, 150, None, 11), ("run a+b", 1, None, None, None), ("run a+b", 2, 152, None, None)]
    assert rd.read_detections(spark, f"{root}/*/segmentation.json", tracked_only=True).count() == 1
    sel = rd.read_frame_selection(spark, f"{root}/*/segmentation.json").orderBy("frame_id").collect()
    assert [(s.detected, s.n_persons, s.crop_x2) for s in sel] == [(True, 2, 12), (False, 0, None), (False, 0, None)]


def test_track_manifest_variants(spark, root):
    put(root, "v", "tracking.json", {"n_frames": 3, "merged_tracks": [7, 9], "frames": [
        {"frame_id": 0, "frame_file": "frame_000150.jpg", "bbox": [0, 0, 10, 20], "detected": True, "interpolated": False},
        {"frame_id": 1, "frame_file": "odd.jpg", "bbox": [0, 0, 10, 20]}, {"frame_id": 2, "frame_file": "frame_000152.jpg", "bbox": [0, 0]}]})
    path = f"{root}/*/tracking.json"
    assert [r.frame_no for r in rd.read_track(spark, path).collect()] == [150]
    assert sorted(r.frame_no for r in rd.read_track(spark, path, on_bad="frame_id").collect()) == [1, 150]
    with pytest.raises(ValueError):
        rd.read_track(spark, path, on_bad="guess")
    dets = spark.createDataFrame([("v", 7), ("v", 8), ("w", 7), ("v", None)], "video string, track_id long")
    flags = {(r.video, r.track_id): r.is_selected for r in flag_merged(dets, rd.read_track_runs(spark, path)).collect()}
    assert flags == {("v", 7): True, ("v", 8): False, ("w", 7): False, ("v", None): False}


def test_annotation_files(spark, root):
    put(root, "v", "gt_centers.csv", "# frame_id,track_id,center_x,center_y\n10,1,1.5,2.5\n20,1,3.0,4.0\n10,1,9.5,8.5\n")
    got = {r.frame_no: (r.center_x, r.center_y) for r in rd.read_gt_centers(spark, f"{root}/*/gt_centers.csv").collect()}
    assert got == {10: (9.5, 8.5), 20: (3.0, 4.0)}
    put(root, "v", "gt_jumps.csv", "jump_id,start_frame,end_frame,start_source_frame,end_source_frame\n1,10,20,160,170\n2,30,30,180,180\n3,40,45,,\n")
    jumps = rd.read_gt_jumps(spark, f"{root}/*/gt_jumps.csv").orderBy("jump_id").collect()
    assert [(j.jump_id, j.start_source_frame) for j in jumps] == [(1, 160), (3, 40)]
    put(root, "v", "gt_venue.csv", "# frame_id,venue_x,venue_y\n10,1.0,2.0\nx,1.0,2.0\n20,3.0\n30,5.0,6.0\n")
    assert sorted(r.frame_no for r in rd.read_gt_venue(spark, f"{root}/*/gt_venue.csv").collect()) == [10, 30]
    with pytest.raises((PySparkException, Py4JJavaError)):
        rd.read_gt_venue(spark, f"{root}/*/gt_venue.csv", strict=True).collect()


def test_projection_needs_positions(spark, root):
    put(root, "v", "projection.json", {"projected_positions": [{"frame_id": 3, "venue_x": 1, "venue_y": 2.5}]})
    assert [(r.frame_no, r.venue_x) for r in rd.read_projection(spark, f"{root}/v/projection.json").collect()] == [(3, 1.0)]
    put(root, "w", "projection.json", {"interp_mode": "pchip"})
    with pytest.raises((PySparkException, Py4JJavaError)):
        rd.read_projection(spark, f"{root}/*/projection.json").collect()


def test_poses_meta_region_and_catalogue(spark, root):
    put(root, "Cup Men_1_80.5_A", "poses_3d.json", {"frames": [{"frame_id": 4, "keypoints_3d": [[1, 2, 3]] * 17}]})
    put(root, "Cup Men_2_0_B", "poses_3d.json", {"frames": []})
    put(root, "Cup Men_3_91_C", "poses_3d.json", {"frames": []})
    put(root, "Cup Men_4_70_D", "other.json", {})
    put(root, "Run_1_70_E", "poses_3d.json", {"frames": []})
    assert [(r.video, r.score) for r in rd.catalogue(spark, f"{root}/*/poses_3d.json", "Cup Men").collect()] == [("Cup Men_3_91_C", 91.0), ("Cup Men_1_80.5_A", 80.5)]
    assert rd.read_poses_3d(spark, f"{root}/*/poses_3d.json").select(F.col("pose")[16]["z"]).first()[0] == 3.0
    put(root, "v", "poses_2d.json", {"keypoint_names": ["nose"], "frames": [{"keypoints": [[1, 2, 0.5]] * 17}, {"frame_id": 9, "keypoints": [[1, 2, 0.5]] * 17}]})
    assert [r.frame_id for r in rd.read_poses_2d(spark, f"{root}/v/poses_2d.json").collect()] == [0, 9]
    put(root, "v", "frames_meta.json", {"source_fps": 50.0, "effective_fps": None, "step": 2})
    videos = spark.createDataFrame([("v",), ("w",)], "video string")
    assert {r.video: r.fps for r in rd.with_fps(videos, rd.read_frames_meta(spark, f"{root}/*/frames_meta.json")).collect()} == {"v": 50.0, "w": 30.0}
    put(root, "v", "start_region.json", {"x1": 1, "y1": 2, "x2": 3, "y2": 4, "venue_w": 10, "venue_h": 20, "venue_image": "a.png"})
    assert rd.read_start_region(spark, f"{root}/*/start_region.json").first().venue_h == 20


def test_documents_are_valid_json_per_video(spark, tmp_path):
    rows = spark.createDataFrame([("a b", f, float(f)) for f in range(25)] + [("c", 0, 1.0)], "video string, frame_id long, x double")
    header = spark.createDataFrame([("a b", 25), ("c", 1), ("empty", 0)], "video string, n_frames long")
    path = f"{tmp_path}/out"
    sk.write_documents(rows.repartition(3), F.struct("frame_id", "x"), path, order="frame_id", header=header)
    docs = {}
    for part in (tmp_path / "out").glob("video=*/part-*"):
        assert part.parent.name not in docs
        docs[part.parent.name] = json.loads(part.read_text())
    assert docs["video=a b"]["n_frames"] == 25 and [f["frame_id"] for f in docs["video=a b"]["frames"]] == list(range(25))
    assert docs["video=empty"] == {"n_frames": 0, "frames": []}


def test_tables_and_stubs(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "video string, v long")
    sk.write_table(df, f"{tmp_path}/t")
    sk.write_table(df.where("video = 'a'").withColumn("v", F.lit(9).cast("long")), f"{tmp_path}/t")
    assert {(r.video, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {("a", 9), ("b", 2)}
    stubs = sk.stub_rows(df, df.where("video = 'a'"), "no frames").collect()
    assert [(s.video, s.n_frames, s.reason) for s in stubs] == [("b", 0, "no frames")]


def test_videos_without_track_ids_pass_through(spark):
    dets = spark.createDataFrame([(0, 0, 1, None, 0, 0, 10, 10, 0.4), (0, 0, 2, None, 0, 0, 20, 20, 0.3), (1, 0, 3, 5, 0, 0, 5, 5, 0.9)], "video_id long, frame_id long, det_no long, track_id long, x1 long, y1 long, x2 long, y2 long, confidence double")
    assert [r.video_id for r in videos_without_tracks(dets).collect()] == [0]
    videos = spark.createDataFrame([(0, 2, 64, 48)], "video_id long, n_frames long, img_w long, img_h long")
    out = passthrough(dets.where("video_id = 0"), videos).orderBy("frame_id").collect()
    assert [(r.x2, r.y2, r.confidence, r.detected, r.interpolated) for r in out] == [(20, 20, 0.3, True, False), (64, 48, 0.0, False, False)]


def test_one_file_a_video_when_a_join_becomes_a_broadcast(spark, tmp_path):
    rows = spark.range(0, 400_000, 1, 4).selectExpr("concat('v', id % 20) AS video", "id AS frame_id", "id * 0.5 AS venue_x", "id * 2.0 AS venue_y")
    jumps = rows.selectExpr("video", "frame_id AS jump_id", "frame_id AS start_frame", "frame_id + 5 AS end_frame", "0L AS start_source_frame", "0L AS end_source_frame")
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    saved = {k: spark.conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        sk.write_annotations(jumps, f"{tmp_path}/csv", order="jump_id", comment_header=False)
        sk.write_documents(rows.withColumnRenamed("frame_id", "frame_no"), sk.projection_record(), f"{tmp_path}/json", order="frame_no", array="projected_positions")
    finally:
        for key, value in saved.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    for kind in ("csv", "json"):
        assert sorted(len(list(p.glob("*.txt"))) for p in (tmp_path / kind).glob("video=*")) == [1] * 20
    assert rd.read_gt_jumps(spark, f"{tmp_path}/csv/*").count() == 400_000
    assert rd.read_projection(spark, f"{tmp_path}/json/*").count() == 400_000
