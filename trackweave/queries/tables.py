"""Queries: names, slices, joins, set operations and file round trips."""

import uuid

from pyspark.sql import functions as F

from trackweave.functions import text as tx
from trackweave.functions.geometry import first_present, half_even
from trackweave.operators import evaluate as ev
from trackweave.operators import sequential as sq
from trackweave.operators import tables as tb
from trackweave.operators import tracks as tr
from trackweave.queries.accuracy import CHUNK, GT_SQL
from trackweave.queries.intervals import JUMP_SQL, jumps
from trackweave.queries.motion import VEL_SQL, rounded, velocity
from trackweave.queries.registry import query
from trackweave.queries.sequential import GUARD_SQL
from trackweave.queries.tracks import CHOSEN_SQL, selection
from trackweave.sources import readers as rd
from trackweave.sources import sinks as sk
from trackweave.session import shared_dir


def scratch(df) -> str:
    """A folder of its own below the shared one, for files that a query writes and reads back."""
    return f"{shared_dir(df.sparkSession)}/files-{uuid.uuid4().hex}"


FILE_SQL = "CASE WHEN det_no % 17 = 0 THEN 'cover.jpg' ELSE 'frame_' || lpad(frame_id::VARCHAR, 6, '0') || CASE WHEN det_no % 2 = 0 THEN '.jpg' ELSE '.png' END END"


def frame_file(frame, det):
    name = F.concat(F.lit("frame_"), F.lpad(frame.cast("string"), 6, "0"), F.when(det % 2 == 0, ".jpg").otherwise(".png"))
    return F.when(det % 17 == 0, "cover.jpg").otherwise(name)


@query("p1_frame_number_and_names", "detections", sql=f"""
WITH n AS (SELECT det_no, {FILE_SQL} AS file, CASE WHEN det_no % 3 = 0 THEN 'take_' ELSE 'cup__' END || video_id || '_run_' || frame_id || '_a_very_long_name_of_a_recording_on_a_slope' AS stem, frame_id FROM detections)
SELECT det_no, CASE WHEN file = 'cover.jpg' THEN NULL ELSE frame_id END AS frame_no, CASE WHEN instr(stem, '__') > 0 THEN stem[instr(stem, '__') + 2:instr(stem, '__') + 46] ELSE stem[1:40] END AS short,
  coalesce(string_split(stem, '_')[4], stem[1:30]) AS fourth FROM n""")
def _(d):
    stem = F.concat(F.when(F.col("det_no") % 3 == 0, "take_").otherwise("cup__"), F.col("video_id").cast("string"), F.lit("_run_"), F.col("frame_id").cast("string"), F.lit("_a_very_long_name_of_a_recording_on_a_slope"))
    n = d.select("det_no", frame_file(F.col("frame_id"), F.col("det_no")).alias("file"), stem.alias("stem"))
    return n.select("det_no", tx.frame_no_from_file("file").alias("frame_no"), tx.short_name("stem").alias("short"), tx.field("stem", 3).alias("fourth"))


@query("s12_score_from_name", "scores", sql="""
SELECT stem, CASE WHEN stem % 5 = 0 THEN NULL ELSE round(score_true, 2) END AS score FROM scores WHERE stem % 5 = 0 OR score_true <> 0""")
def _(scores):
    name = F.concat(F.lit("Cup_"), F.col("stem").cast("string"), F.lit("_"), F.when(F.col("stem") % 5 == 0, "dnf").otherwise(F.format_string("%.2f", "score_true")), F.lit("_x"))
    return scores.select("stem", tx.score_from_name(name).alias("score")).where("score IS NULL OR score <> 0")


@query("p8_frame_sampling", "videos", sql="""
WITH v AS (SELECT video_id, 25.0::DOUBLE + video_id % 3 * 5 AS fps, n_frames * 4 AS total FROM videos),
b AS (SELECT *, floor(5 * fps)::BIGINT AS s, least(greatest(floor(5 * fps)::BIGINT + 1, floor((total / fps - 2) * fps)::BIGINT), total) AS e, CASE WHEN fps > 12 THEN greatest(1, round_even(fps / 12, 0)::BIGINT) ELSE 1 END AS step FROM v),
f AS (SELECT video_id, step, r.i AS frame_no FROM b, LATERAL (SELECT unnest(range(s, e)) AS i) r WHERE r.i % step = 0)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_no) - 1 AS frame_id, frame_no, step FROM f""")
def _(videos):
    v = videos.select("video_id", (F.lit(25.0) + F.col("video_id") % 3 * 5).alias("source_fps"), (F.col("n_frames") * 4).alias("total_frames"))
    return tb.sampled_frames(v, target_fps=12.0, trim_start=5.0, trim_end=2.0).select("video_id", "frame_id", "frame_no", "step")


@query("p23_output_rounding", "dense", "camera_flow", sql=f"""
WITH {VEL_SQL} SELECT video_id, frame_id, round_even(center_x, 0) + 0.0 AS center_x, round_even(vel_dx * 2, 0) / 2 + 0.0 AS half_dx FROM vel""")
def _(dense, flow):
    vel = velocity(dense, flow)
    return vel.select("video_id", "frame_id", (half_even("center_x") + F.lit(0.0)).alias("center_x"), (half_even(F.col("vel_dx") * 2) / 2 + F.lit(0.0)).alias("half_dx"))


@query("p24_fallback_chain", "dense", "track", "videos", sql="""
SELECT d.video_id, d.frame_id, coalesce(t.x1, d.x1, 0) AS x1, coalesce(CASE WHEN d.video_id % 2 = 0 THEN 24.0::DOUBLE END, CASE WHEN d.video_id % 3 = 0 THEN 50.0::DOUBLE END, 30.0::DOUBLE) AS fps FROM dense d LEFT JOIN track t ON d.video_id = t.video_id AND d.frame_id = t.frame_id""")
def _(dense, track, _videos):
    t = track.select("video_id", "frame_id", F.col("x1").alias("t1"))
    fps = first_present(F.when(F.col("video_id") % 2 == 0, 24.0), F.when(F.col("video_id") % 3 == 0, 50.0), F.lit(30.0))
    return dense.join(t, ["video_id", "frame_id"], "left").select("video_id", "frame_id", first_present("t1", "x1", F.lit(0)).alias("x1"), fps.alias("fps"))


@query("p26_every_nth_by_position", "track", sql="""
SELECT video_id, frame_id, (row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1) % 7 = 0 AS kept FROM track""")
def _(track):
    return tb.every_nth(track, 7, chunk=CHUNK).select("video_id", "frame_id", "kept")


@query("k10_first_fifty_frames", "track", sql="""
SELECT video_id, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS rn FROM track) q WHERE rn <= 50""")
def _(track):
    return tb.first_rows(track, 50, chunk=CHUNK).select("video_id", "frame_id")


@query("k10_first_videos", "videos", sql="SELECT video_id FROM videos ORDER BY video_id LIMIT 10")
def _(videos):
    return tb.first_videos(videos, 10).select("video_id")


@query("p27_frame_slices", "dense", sql="SELECT video_id, frame_id, x1 FROM dense WHERE frame_id BETWEEN 100 AND 180 OR frame_id IN (5, 300, 411)")
def _(dense):
    return tb.frame_slice(dense, between=(100, 180), frames=(5, 300, 411)).select("video_id", "frame_id", "x1")


@query("j8_work_queue", "videos", "run_results", sql="""
WITH want AS (SELECT video_id, s.stage FROM videos CROSS JOIN (VALUES ('F'), ('O'), ('P')) s(stage)), done AS (SELECT DISTINCT video_id, stage FROM run_results WHERE elapsed_s > 0)
SELECT w.video_id, w.stage FROM want w WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.video_id = w.video_id AND d.stage = w.stage)""")
def _(videos, results):
    want = videos.select("video_id", F.explode(F.array(*[F.lit(s) for s in ("F", "O", "P")])).alias("stage"))
    return tb.pending(want, results.where("elapsed_s > 0").select("video_id", "stage").distinct(), ["video_id", "stage"])


@query("j11_manifest_preference", "track", "dense", sql="""
SELECT d.video_id, d.frame_id, CASE WHEN t.video_id IS NOT NULL THEN t.x1 ELSE d.x1 END AS x1, t.video_id IS NOT NULL AS from_first FROM dense d LEFT JOIN track t ON d.video_id = t.video_id AND d.frame_id = t.frame_id""")
def _(track, dense):
    return tb.prefer(track, dense, ["x1"])


@query("j12_positional_zip", "track", "frames", sql="""
WITH a AS (SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS i FROM track), b AS (SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS i FROM frames)
SELECT a.video_id, a.frame_id, a.i AS position, b.frame_id AS right_frame_id FROM a JOIN b ON a.video_id = b.video_id AND a.i = b.i""")
def _(track, frames):
    return tb.zip_by_position(track.select("video_id", "frame_id"), frames, chunk=CHUNK)


@query("j21_selected_track_flag", "detections", "videos", sql=f"""
WITH {CHOSEN_SQL} SELECT d.det_no, coalesce(p.selected, false) AS is_selected FROM detections d LEFT JOIN picked p ON d.video_id = p.video_id AND d.track_id = p.track_id AND p.selected""")
def _(d, v):
    return tb.flag_selected(d, selection(d, v).where("selected")).select("det_no", "is_selected")


@query("u1_common_frames", "track", "gt_centers", sql="SELECT video_id, frame_id FROM track INTERSECT SELECT video_id, frame_id FROM gt_centers")
def _(track, gt):
    return tb.common_keys(track, gt)


@query("u2_truth_only_frames", "track", "frames", "gt_centers", sql=f"WITH {GT_SQL} SELECT video_id, frame_id FROM gt_dense EXCEPT SELECT video_id, frame_id FROM track")
def _(track, frames, gt):
    return tb.only_in(ev.interpolate_keyframes(frames, gt, chunk=CHUNK), track)


@query("u3_union_of_video_sets", "track", "run_results", sql="SELECT video_id FROM track UNION SELECT video_id FROM run_results")
def _(track, results):
    return track.select("video_id").unionByName(results.select("video_id")).distinct()


@query("u5_annotation_upsert", "track", "gt_centers", sql="""
SELECT coalesce(t.video_id, g.video_id) AS video_id, coalesce(t.frame_id, g.frame_id) AS frame_id, coalesce(g.center_x, t.cx) AS center_x, coalesce(g.center_y, t.cy) AS center_y,
  coalesce(g.video_id IS NOT NULL AND (t.video_id IS NULL OR abs(g.center_x - t.cx) > 0.5 OR abs(g.center_y - t.cy) > 0.5), false) AS corrected
FROM track t FULL JOIN gt_centers g ON t.video_id = g.video_id AND t.frame_id = g.frame_id""")
def _(track, gt):
    auto = track.select("video_id", "frame_id", F.col("cx").alias("center_x"), F.col("cy").alias("center_y"))
    return tb.upsert_annotations(auto, gt)


# ---------------------------------------------------------------- files written from the tables and read back


def named(df):
    return df.withColumn("video", F.concat(F.lit("run "), F.col("video_id").cast("string")))


@query("s1_detection_manifest", "detections", sql="""
SELECT 'run ' || video_id AS video, frame_id, track_id, x1, y1, x2, y2, confidence FROM detections""")
def _(d):
    path = scratch(d)
    person = F.struct("det_no", F.array("x1", "y1", "x2", "y2").alias("bbox"), "confidence", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), "track_id")
    frames = named(d).groupBy("video", "frame_id").agg(F.sort_array(F.collect_list(person)).alias("persons"))
    record = F.struct("frame_id", F.concat(F.lit("frame_"), F.lpad(F.col("frame_id").cast("string"), 6, "0"), F.lit(".jpg")).alias("frame_file"), F.lit(True).alias("detected"), "persons")
    sk.write_documents(frames, record, path, order="frame_id")
    return rd.read_detections(d.sparkSession, f"{path}/*").select("video", "frame_id", "track_id", "x1", "y1", "x2", "y2", "confidence")


def _track_documents(dense, path):
    rows = named(dense).withColumns({
        "frame_file": frame_file(F.col("frame_id"), F.col("frame_id")), **{f"crop_{c}": F.col(c) for c in ("x1", "y1", "x2", "y2")},
        "of_synthetic": F.lit(False), "vx": F.lit(None).cast("double"), "vy": F.lit(None).cast("double"), "speed": F.lit(None).cast("double")})
    header = rows.groupBy("video").agg(F.count(F.lit(1)).alias("n_frames")).withColumn("merged_tracks", F.array(F.lit(1), F.lit(3)))
    sk.write_documents(rows, sk.track_record(), path, order="frame_id", header=header)


@query("s2_s13_track_manifest", "dense", sql="""
SELECT 'run ' || video_id AS video, frame_id, frame_id AS frame_no, x1, y1, x2, y2, detected, interpolated, round(confidence, 2) AS confidence FROM dense WHERE frame_id % 17 <> 0""")
def _(dense):
    # frames whose file has no number are dropped, which is what this variant does
    path = scratch(dense)
    _track_documents(dense, path)
    return rd.read_track(dense.sparkSession, f"{path}/*").select("video", "frame_id", "frame_no", "x1", "y1", "x2", "y2", "detected", "interpolated", F.round("confidence", 2).alias("confidence"))


@query("s2_track_manifest_frame_id_fallback", "dense", sql="SELECT 'run ' || video_id AS video, frame_id, frame_id AS frame_no, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy FROM dense")
def _(dense):
    path = scratch(dense)
    _track_documents(dense, path)
    return rd.read_track(dense.sparkSession, f"{path}/*", on_bad="frame_id").select("video", "frame_id", "frame_no", "cx", "cy")


@query("s3_s16_centre_annotations", "gt_centers", sql="""
SELECT 'run ' || video_id AS video, frame_id AS frame_no, 1::BIGINT AS track_id, round(center_x, 1) + 0.0 AS center_x, round(center_y, 1) + 0.0 AS center_y FROM gt_centers""")
def _(gt):
    path = scratch(gt)
    sk.write_annotations(sk.centre_rows(named(gt).withColumnRenamed("frame_id", "frame_no")), path)
    return rounded(rd.read_gt_centers(gt.sparkSession, f"{path}/*"), "center_x", "center_y")


@query("s4_s16_jump_annotations", "gt_jumps_raw", sql="""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_frame, end_frame) AS jump_no FROM gt_jumps_raw)
SELECT 'run ' || video_id AS video, jump_no AS jump_id, start_frame, end_frame, start_frame + 150 AS start_source_frame FROM n WHERE end_frame > start_frame""")
def _(gt):
    path = scratch(gt)
    rows = named(gt).withColumns({"start_source_frame": F.col("start_frame") + 150, "end_source_frame": F.col("end_frame") + 150})
    sk.write_annotations(sk.jump_rows(rows), path, order="jump_id", comment_header=False)
    return rd.read_gt_jumps(gt.sparkSession, f"{path}/*").select("video", "jump_id", "start_frame", "end_frame", "start_source_frame")


@query("s5_s16_venue_annotations", "gt_venue", sql="""
SELECT 'run ' || video_id AS video, frame_id AS frame_no, round(venue_x, 1) + 0.0 AS venue_x, round(venue_y, 1) + 0.0 AS venue_y FROM gt_venue""")
def _(gt):
    path = scratch(gt)
    sk.write_annotations(sk.venue_rows(named(gt).withColumnRenamed("frame_id", "frame_no")), path)
    return rounded(rd.read_gt_venue(gt.sparkSession, f"{path}/*"), "venue_x", "venue_y")


@query("s6_s14_velocity_manifest", "dense", "camera_flow", sql=f"""
WITH {VEL_SQL} SELECT 'run ' || video_id AS video, frame_id, round(center_x, 2) + 0.0 AS center_x, round(vel_dx, 2) + 0.0 AS athlete_vel_dx, round(flow_dx, 2) + 0.0 AS camera_flow_dx FROM vel""")
def _(dense, flow):
    path = scratch(dense)
    vel = named(velocity(dense, flow)).withColumns({"frame_file": F.lit("frame_000001.jpg"), "in_jump": F.lit(False)})
    sk.write_documents(vel, sk.velocity_record(), path, order="frame_id")
    back = rd.read_velocity(dense.sparkSession, f"{path}/*")
    return back.select("video", "frame_id", *[(F.round(c, 2) + F.lit(0.0)).alias(c) for c in ("center_x", "athlete_vel_dx", "camera_flow_dx")])


@query("s7_s14_pose_2d_manifest", "poses", sql="SELECT 'run ' || video_id AS video, frame_id, joint, round(x, 6) + 0.0 AS x, round(conf, 6) + 0.0 AS conf FROM pose_points")
def _(poses):
    path = scratch(poses)
    sk.write_documents(named(poses), sk.pose_record("kp", ("x", "y", "conf"), "keypoints"), path, order="frame_id")
    back = rd.read_poses_2d(poses.sparkSession, f"{path}/*").select("video", "frame_id", F.posexplode("kp").alias("joint", "p"))
    return rounded(back.select("video", "frame_id", "joint", "p.x", "p.conf"), "x", "conf")


@query("s8_pose_3d_manifest", "poses", sql="""
WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS pos FROM pose_points) SELECT 'run ' || video_id AS video, pos AS frame_id, joint, round(z, 6) + 0.0 AS z FROM r""")
def _(poses):
    path = scratch(poses)
    sk.write_documents(named(poses), sk.pose_record("pose", ("x", "y", "z"), "keypoints_3d"), path, order="frame_id")
    back = rd.read_poses_3d(poses.sparkSession, f"{path}/*").select("video", "frame_id", F.posexplode("pose").alias("joint", "p"))
    return rounded(back.select("video", "frame_id", "joint", "p.z"), "z")


@query("s9_s14_projection_manifest", "gt_venue", sql="SELECT 'run ' || video_id AS video, frame_id AS frame_no, round(venue_x, 6) + 0.0 AS venue_x, round(venue_y, 6) + 0.0 AS venue_y FROM gt_venue")
def _(gt):
    path = scratch(gt)
    rows = named(gt).withColumnRenamed("frame_id", "frame_no")
    sk.write_documents(rows, sk.projection_record(), path, order="frame_no", array="projected_positions")
    return rounded(rd.read_projection(gt.sparkSession, f"{path}/*"), "venue_x", "venue_y")


@query("s10_trace_manifest_and_fps", "trace", "videos", sql="""
SELECT 'run ' || video_id AS video, frame_id AS idx, trace_x AS x, trace_y AS y, 30.0::DOUBLE AS fps FROM trace""")
def _(trace, videos):
    path = scratch(trace)
    record = F.struct(F.col("frame_id").alias("idx"), F.col("trace_x").alias("x"), F.col("trace_y").alias("y"), F.lit(True).alias("ok"))
    sk.write_documents(named(trace), record, path, order="frame_id", array="trace")
    back = rd.read_flow_trace(trace.sparkSession, f"{path}/*").select("video", "idx", "x", "y")
    no_meta = named(videos).select("video", F.lit(None).cast("double").alias("effective_fps"), F.lit(None).cast("double").alias("source_fps"))
    return rd.with_fps(back, no_meta)


@query("s11_s17_discovery_and_stubs", "run_results", "videos", sql="""
SELECT 'run ' || video_id AS video, 0::BIGINT AS n_frames, 'no result' AS reason FROM videos WHERE video_id NOT IN (SELECT video_id FROM run_results)""")
def _(results, videos):
    path = scratch(results)
    rows = results.groupBy("video_id", "config", "stage").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.concat_ws(" ", "config", "stage"))
    sk.write_documents(named(rows), F.struct("config", "stage", "n"), path, order="part")
    return sk.stub_rows(named(videos), rd.discover(results.sparkSession, f"{path}/*/*.txt"), "no result")


@query("s6_jump_documents", "dense", "camera_flow", sql=f"""
WITH {JUMP_SQL} SELECT 'run ' || video_id AS video, row_number() OVER (PARTITION BY video_id ORDER BY start_frame) - 1 AS jump_id, start_frame, end_frame, peak_frame, airtime_frames, round(peak_speed, 4) + 0.0 AS peak_speed FROM jumps""")
def _(dense, flow):
    path = scratch(dense)
    _velocity_documents(dense, flow, path)
    return rd.read_jumps(dense.sparkSession, f"{path}/*").withColumn("peak_speed", F.round("peak_speed", 4) + F.lit(0.0))


@query("s14_velocity_summary_documents", "dense", "camera_flow", sql=f"""
WITH {JUMP_SQL}, n AS (SELECT video_id, count(*) AS n_jumps FROM jumps GROUP BY video_id)
SELECT 'run ' || v.video_id AS video, count(*) AS n_frames, round(avg(speed), 2) + 0.0 AS mean_speed, round(max(speed), 2) + 0.0 AS max_speed, coalesce(any_value(n_jumps), 0) AS n_jumps FROM vel v LEFT JOIN n ON n.video_id = v.video_id GROUP BY v.video_id""")
def _(dense, flow):
    path = scratch(dense)
    _velocity_documents(dense, flow, path)
    back = rd.read_velocity_runs(dense.sparkSession, f"{path}/*")
    return back.withColumns({c: F.round(c, 2) + F.lit(0.0) for c in ("mean_speed", "max_speed")})


def _velocity_documents(dense, flow, path):
    vel = named(velocity(dense, flow)).withColumns({"frame_file": F.lit("frame_000001.jpg"), "in_jump": F.lit(False)})
    sk.write_documents(vel, sk.velocity_record(), path, order="frame_id", header=sk.velocity_header(vel, named(jumps(dense, flow))))


@query("s13_run_headers", "detections", "videos", "track", "trace", sql=f"""
WITH RECURSIVE {CHOSEN_SQL}, {GUARD_SQL},
best AS (SELECT video_id, count(*) AS n, first(track_id ORDER BY score DESC, first_key) AS track_id, max(score) AS score, list(track_id ORDER BY score DESC, first_key) AS ids FROM picked WHERE selected GROUP BY video_id),
bad AS (SELECT video_id, count(*) FILTER (NOT accepted) AS rejections FROM g GROUP BY video_id),
t AS (SELECT video_id, count(*) AS n_frames, avg(sqrt(cx^2 + cy^2)) AS mean_speed, max(sqrt(cx^2 + cy^2)) AS max_speed, avg(cy) AS mean_vy FROM track GROUP BY video_id)
SELECT 'run ' || t.video_id AS video, n_frames, b.track_id AS selected_track_id, CASE WHEN n > 1 THEN array_to_string(ids, ',') END AS merged_tracks, round(score, 4) + 0.0 AS track_score,
  rejections AS identity_guard_rejections, round(mean_speed, 2) + 0.0 AS mean_speed, round(max_speed, 2) + 0.0 AS max_speed, round(mean_vy, 2) + 0.0 AS mean_vy
FROM t LEFT JOIN best b ON b.video_id = t.video_id LEFT JOIN bad ON bad.video_id = t.video_id""")
def _(detections, videos, track, trace):
    path = scratch(track)
    ranked = tr.rank_tracks(selection(detections, videos).where("selected"))
    # positions stand in for velocities, of which the given tables have none
    frames = named(track).withColumns({"vx": F.col("cx"), "vy": F.col("cy")})
    guarded = sq.guard_identity(track.drop("cx", "cy"), trace, max_jump=60.0)
    rejections = named(guarded.groupBy("video_id").agg(F.count_if(~F.col("accepted")).alias("rejections")))
    header = sk.run_header(frames, named(ranked), rejections=rejections, settings={"smooth_window": F.lit(5)})
    sk.write_documents(frames.select("video", "frame_id"), F.struct("frame_id"), path, order="frame_id", header=header)
    back = rd.read_track_runs(track.sparkSession, f"{path}/*")
    r = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c.split(".")[-1])
    merged = F.when(F.col("merged_tracks").isNotNull(), F.array_join(F.col("merged_tracks").cast("array<string>"), ","))
    return back.select("video", "n_frames", "selected_track_id", merged.alias("merged_tracks"), r("track_score", 4), "identity_guard_rejections", *[r(f"velocity_stats.{c}", 2) for c in ("mean_speed", "max_speed", "mean_vy")])


@query("s10_frame_rates_from_metadata", "videos", "run_results", sql="""
SELECT 'run ' || v.video_id AS video, CASE WHEN r.video_id IS NULL THEN 30 WHEN v.video_id % 3 > 0 THEN v.n_frames / 20.0::DOUBLE WHEN v.video_id % 2 > 0 THEN 24 + v.video_id ELSE 30 END::DOUBLE AS fps
FROM videos v LEFT JOIN (SELECT DISTINCT video_id FROM run_results) r ON r.video_id = v.video_id""")
def _(videos, results):
    # documents only for videos with results; some have one rate, some the other, some neither
    path = scratch(videos)
    have = videos.join(results.select("video_id").distinct(), "video_id", "left_semi")
    meta = named(have).select(
        "video", F.when(F.col("video_id") % 2 > 0, F.lit(24.0) + F.col("video_id")).alias("source_fps"), F.when(F.col("video_id") % 3 > 0, F.col("n_frames") / F.lit(20.0)).alias("effective_fps"),
        F.col("n_frames").alias("extracted_frames"))
    sk.write_records(meta, path)
    return rd.with_fps(named(videos).select("video"), rd.read_frames_meta(videos.sparkSession, f"{path}/*"))


@query("s10_start_regions", "gt_venue", sql="""
SELECT 'run ' || video_id AS video, floor(min(venue_x))::BIGINT AS x1, floor(min(venue_y))::BIGINT AS y1, ceil(max(venue_x))::BIGINT AS x2, ceil(max(venue_y))::BIGINT AS y2, 'map.png' AS venue_image FROM gt_venue GROUP BY video_id""")
def _(gt):
    path = scratch(gt)
    bounds = named(gt).groupBy("video").agg(
        F.floor(F.min("venue_x")).alias("x1"), F.floor(F.min("venue_y")).alias("y1"), F.ceil(F.max("venue_x")).alias("x2"), F.ceil(F.max("venue_y")).alias("y2"), F.lit("map.png").alias("venue_image"))
    sk.write_records(bounds, path)
    return rd.read_start_region(gt.sparkSession, f"{path}/*").select("video", "x1", "y1", "x2", "y2", "venue_image")


@query("s12_catalogue", "videos", "run_results", sql="""
WITH n AS (SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 'Cup Men' ELSE 'Cup Women' END || '_' || video_id || '_' || CASE WHEN video_id % 7 = 3 THEN 'dnf' WHEN video_id % 7 = 4 THEN '0.00' ELSE n_frames::VARCHAR || '.50' END || '_x' AS video,
  CASE WHEN video_id % 7 = 3 THEN NULL WHEN video_id % 7 = 4 THEN 0 ELSE n_frames + 0.5::DOUBLE END AS score FROM videos)
SELECT video, score FROM n WHERE video LIKE 'Cup Men%' AND score <> 0 AND video_id IN (SELECT video_id FROM run_results)""")
def _(videos, results):
    # only videos with results have a pose file
    path = scratch(videos)
    v = F.col("video_id")
    part = F.when(v % 7 == 3, "dnf").when(v % 7 == 4, "0.00").otherwise(F.concat(F.col("n_frames").cast("string"), F.lit(".50")))
    name = F.concat_ws("_", F.when(v % 2 == 0, "Cup Men").otherwise("Cup Women"), v.cast("string"), part, F.lit("x"))
    have = videos.join(results.select("video_id").distinct(), "video_id", "left_semi")
    sk.write_records(have.select(name.alias("video"), "n_frames"), path)
    return rd.catalogue(videos.sparkSession, f"{path}/*/*.txt", "Cup Men")


@query("s13_track_table", "dense", sql="SELECT video_id, frame_id, x1, detected FROM dense")
def _(dense):
    path = scratch(dense)
    sk.write_table(dense.select("video_id", "frame_id", "x1", "detected"), path, by=("video_id",))
    return dense.sparkSession.read.parquet(path).select(F.col("video_id").cast("long").alias("video_id"), "frame_id", "x1", "detected")


@query("s15_result_table", "run_results", sql="SELECT config, video_id, count(*) AS n, round(sum(elapsed_s), 4) AS total FROM run_results GROUP BY ALL")
def _(results):
    path = scratch(results)
    out = results.groupBy("config", "video_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("elapsed_s"), 4).alias("total"))
    sk.write_results(out, path)
    return results.sparkSession.read.parquet(path).select("config", "video_id", "n", "total")
