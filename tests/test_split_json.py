"""Documents cut at byte ranges read as whole ones do."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trackweave.sources import readers as rd
from trackweave.sources import schemas as sc
from trackweave.sources import split_json as sj


def document(n, seed, indent):
    r = random.Random(seed)
    name = lambda i: r.choice([f"frame_{i:06d}.jpg", 'odd "}{" \\ name.jpg', "a[{]}:,", "é {", "\\\"", ""])
    person = lambda: {"bbox": [r.randint(0, 99) for _ in range(4)], "confidence": round(r.random(), 3), "area": r.randint(1, 999), "track_id": r.choice([None, r.randint(0, 5)])}
    frames = [{"frame_id": i, "frame_file": name(i), "detected": r.random() < 0.5, "bbox": None if r.random() < 0.3 else [1, 2, 3, i], "persons": [person() for _ in range(r.randint(0, 3))]} for i in range(n)]
    jumps = [{"start_frame_id": i, "end_frame_id": i + 7, "peak_frame_id": i + 3, "airtime_frames": 8, "peak_speed_px_per_frame": 1.5} for i in range(r.randint(0, 4))]
    return json.dumps({"video_stem": "a {b} \"c\"", "weights": {"w": {"v": 1}, "s": "}"}, "n_frames": n, "jumps": jumps, "merged_tracks": [7, 9], "frames": frames, "note": "x}y{", "summary": {"mean": 2.5}},
                      indent=indent, ensure_ascii=seed % 2 == 0) + ("\n" if seed % 3 == 0 else "")


@pytest.fixture
def files(tmp_path):
    for seed, (n, indent) in enumerate([(40, None), (25, 2), (0, 2), (1, None), (60, 1)]):
        folder = tmp_path / f"run {seed}"
        folder.mkdir()
        (folder / "all.json").write_text(document(n, seed, indent), encoding="utf-8")
    return f"{tmp_path}/*/all.json"


@pytest.mark.parametrize("block", [300])
def test_split_reading_equals_whole_reading(spark, files, block, monkeypatch):
    whole = {}
    reads = {
        "people": lambda: rd.read_detections(spark, files), "jumps": lambda: rd.read_jumps(spark, files),
        "track": lambda: rd.read_track(spark, files, on_bad="frame_id")}
    for name, read in reads.items():
        whole[name] = sorted(map(repr, read().collect()))
    monkeypatch.setattr(rd, "SPLIT_BYTES", 0)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        for name, read in reads.items():
            assert sorted(map(repr, read().collect())) == whole[name], name
        kept = sj.read_elements(spark, files, sc.TRACK_MANIFEST, "frames", ("video_stem", "n_frames", "merged_tracks")).select("video_stem", "n_frames", "merged_tracks").distinct().collect()
        assert sorted((r.video_stem, r.n_frames, tuple(r.merged_tracks)) for r in kept) == [('a {b} "c"', n, (7, 9)) for n in (1, 25, 40, 60)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_long_document_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "v").mkdir()
    record = json.dumps({"frame_id": 0, "frame_file": "frame_000001.jpg", "detected": True, "bbox": [1.5] * 4, "persons": [{"bbox": [1.0] * 4, "confidence": 0.5, "area": 3, "track_id": 1}] * 8})
    (tmp_path / "v" / "all.json").write_text('{"frames": [' + ", ".join([record] * 20_000) + "]}")
    path = f"{tmp_path}/*/all.json"
    monkeypatch.setattr(rd, "SPLIT_BYTES", 1 << 20)
    assert sj.longest_file(spark, path) > 10 << 20
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        assert spark.read.option("lineSep", "}").text(path).select(F.spark_partition_id()).distinct().count() > 10
        assert rd.read_detections(spark, path).agg(F.count("*"), F.sum("area"), F.max("det_no")).first() == (160_000, 480_000, 7)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
