"""Queries: track fragments, their scores and their selection."""

from pyspark.sql import functions as F

from trackweave.functions import geometry as g
from trackweave.functions.geometry import r6
from trackweave.operators import evaluate as ev
from trackweave.operators import tracks as tr
from trackweave.queries.accuracy import CHUNK, GT_SQL
from trackweave.queries.registry import query

PARAMS = tr.SelectionParams(threshold=0.6, adaptive=True, threshold_low=0.5, threshold_high=0.6, min_overlap_ratio=0.55)
SHORT = tr.SelectionParams(min_frames=1000, threshold=0.6)

SCORED_SQL = """
boxed AS (SELECT *, CAST(x1 + x2 AS DOUBLE) / 2 AS cx, CAST(y1 + y2 AS DOUBLE) / 2 AS cy FROM detections WHERE track_id IS NOT NULL),
scored AS (
  SELECT b.video_id, b.track_id, avg(confidence) AS mean_conf, count(*) AS n, min(frame_id) AS ff, min(frame_id * 1000000000 + det_no) AS first_key,
         avg(1 - sqrt((cx - 960)^2 + (cy - 540)^2) / sqrt(960.0^2 + 540.0^2)) AS mean_center, any_value(n_frames) AS n_frames,
         0.3 * avg(confidence) + 0.5 * avg(1 - sqrt((cx - 960)^2 + (cy - 540)^2) / sqrt(960.0^2 + 540.0^2)) + 0.2 * count(*) / any_value(n_frames) AS score
  FROM boxed b JOIN videos v ON b.video_id = v.video_id GROUP BY b.video_id, b.track_id)"""
CHOSEN_SQL = SCORED_SQL + """,
limits AS (
  SELECT video_id, coalesce(sum(n) FILTER (score >= 0.6), 0)::DOUBLE / max(n_frames) AS high_rate FROM scored WHERE n >= 10 GROUP BY video_id),
chosen AS (
  SELECT s.*, CASE WHEN high_rate < 0.55 THEN 0.5 ELSE 0.6 END AS threshold, high_rate,
         score >= CASE WHEN high_rate < 0.55 THEN 0.5 ELSE 0.6 END AS over,
         max(score) OVER (PARTITION BY s.video_id) < CASE WHEN high_rate < 0.55 THEN 0.5 ELSE 0.6 END AS used_fallback,
         row_number() OVER (PARTITION BY s.video_id ORDER BY score DESC, first_key) AS rn
  FROM scored s JOIN limits l ON s.video_id = l.video_id WHERE n >= 10),
picked AS (SELECT *, over OR (used_fallback AND rn = 1) AS selected FROM chosen)"""


def _r6(df, *plain, **_):
    return [r6(F.col(c)).alias(c) for c in plain]


@query("p2_box_geometry", "detections", sql="""
SELECT det_no, (x1 + x2)::DOUBLE / 2 AS cx, (y1 + y2)::DOUBLE / 2 AS cy, x2 - x1 AS box_w, y2 - y1 AS box_h,
       greatest(1.0::DOUBLE, ((x2 - x1) * (y2 - y1))::DOUBLE) AS area FROM detections""")
def _(d):
    return g.with_box_geometry(d).select("det_no", "cx", "cy", "box_w", "box_h", "area")


@query("p4_detection_quality", "detections", "videos", sql="""
SELECT det_no, round(0.3 * confidence + 0.5 * (1 - sqrt(((x1 + x2) / 2.0::DOUBLE - 960)^2 + ((y1 + y2) / 2.0::DOUBLE - 540)^2) / sqrt(960.0^2 + 540.0^2)), 6) + 0.0 AS quality
FROM detections""")
def _(d, v):
    return g.with_box_geometry(d).join(v, "video_id").select(
        "det_no", r6(g.quality("confidence", "cx", "cy", "img_w", "img_h")).alias("quality"))


@query("p7_track_filters", "detections", sql="""
SELECT video_id, track_id, count(*) AS n FROM detections WHERE track_id IS NOT NULL AND confidence >= 0.5
GROUP BY video_id, track_id HAVING count(*) >= 10""")
def _(d):
    kept = d.where(F.col("track_id").isNotNull() & (F.col("confidence") >= 0.5))
    return kept.groupBy("video_id", "track_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@query("a1_track_scores", "detections", "videos", sql=f"""
WITH {SCORED_SQL}
SELECT video_id, track_id, n, round(mean_conf, 6) + 0.0 AS mean_conf, round(mean_center, 6) + 0.0 AS mean_center,
       round(score, 6) + 0.0 AS score FROM scored WHERE n >= 10""")
def _(d, v):
    s = tr.track_scores(d, v, PARAMS).where("long_enough")
    return s.select("video_id", "track_id", "n", *_r6(s, "mean_conf", "mean_center", "score"))


@query("a2_longest_track_fallback", "detections", "videos", sql=f"""
WITH {SCORED_SQL}
SELECT video_id, track_id, n, 0.0::DOUBLE AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, first_key) AS rn FROM scored) q WHERE rn = 1""")
def _(d, v):
    return tr.competing_tracks(tr.track_scores(d, v, SHORT)).select("video_id", "track_id", "n", "score")


@query("a3_adaptive_threshold", "detections", "videos", sql=f"""
WITH {CHOSEN_SQL}
SELECT DISTINCT video_id, round(high_rate, 6) + 0.0 AS high_rate, threshold::DOUBLE AS threshold FROM chosen""")
def _(d, v):
    t = tr.choose_threshold(tr.competing_tracks(tr.track_scores(d, v, PARAMS)), PARAMS)
    return t.select("video_id", r6(F.col("high_rate")).alias("high_rate"), "threshold")


def selection(d, v, params=PARAMS):
    return tr.select_tracks(tr.competing_tracks(tr.track_scores(d, v, params)), params)


@query("a4_track_selection", "detections", "videos", sql=f"""
WITH {CHOSEN_SQL}
SELECT video_id, track_id, round(score, 6) + 0.0 AS score, selected, used_fallback FROM picked""")
def _(d, v):
    return selection(d, v).select("video_id", "track_id", r6(F.col("score")).alias("score"), "selected", "used_fallback")


@query("a5_candidate_pool", "detections", "videos", sql=f"""
WITH {CHOSEN_SQL},
pool AS (SELECT d.video_id, frame_id, count(*) AS c, sum(confidence) AS s, min(confidence) AS lo, max(confidence) AS hi
         FROM detections d JOIN picked p ON d.video_id = p.video_id AND d.track_id = p.track_id AND p.selected GROUP BY d.video_id, frame_id),
pf AS (SELECT video_id, count(*) AS frames_with_detections, sum(c)::BIGINT AS total_candidates, round(avg(c), 6) + 0.0 AS avg_candidates,
              count(*) FILTER (c > 1) AS multi_frames, round(avg(CASE WHEN c > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS multi_ratio,
              round(sum(s) / sum(c), 6) + 0.0 AS confidence_mean, min(lo) AS confidence_min, max(hi) AS confidence_max FROM pool GROUP BY video_id)
SELECT t.*, pf.* EXCLUDE (video_id) FROM (
  SELECT video_id, any_value(threshold)::DOUBLE AS threshold_used, any_value(used_fallback) AS threshold_fallback,
         count(*) FILTER (selected) AS merged_tracks, count(*) FILTER (NOT over AND NOT used_fallback) AS excluded_tracks
  FROM picked GROUP BY video_id) t LEFT JOIN pf ON t.video_id = pf.video_id""")
def _(d, v):
    s = selection(d, v)
    out = tr.pool_diagnostics(tr.candidates(d, s), s)
    rounded = ("avg_candidates", "multi_ratio", "confidence_mean")
    return out.select(*[r6(F.col(c)).alias(c) if c in rounded else F.col(c) for c in out.columns])


@query("a5_track_status", "detections", "videos", sql=f"""
WITH {CHOSEN_SQL}
SELECT video_id, track_id, round(score, 6) + 0.0 AS score, n,
       CASE WHEN selected THEN 'included' WHEN used_fallback THEN 'unlisted' ELSE 'excluded' END AS status,
       CASE WHEN abs(score - threshold) <= 0.05 THEN CASE WHEN over THEN 'included' ELSE 'excluded' END END AS near_side FROM picked""")
def _(d, v):
    out = tr.track_status(selection(d, v))
    return out.withColumn("score", r6(F.col("score")))


@query("k2_track_rank", "detections", "videos", sql=f"""
WITH {SCORED_SQL}
SELECT video_id, track_id, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, first_key) AS rank FROM scored""")
def _(d, v):
    return tr.rank_tracks(tr.track_scores(d, v)).select("video_id", "track_id", "rank")


@query("a15_rescoring_audit", "detections", "videos", sql=f"""
WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, first_key) AS rank FROM scored)
SELECT video_id, track_id, rank, rank <= 5 AND score >= 0.5 AS selected FROM r""")
def _(d, v):
    return tr.selection_audit(tr.track_scores(d, v), top_n=5, threshold=0.5).select("video_id", "track_id", "rank", "selected")


for _strategy, _key in (("largest", "greatest(1, (x2 - x1) * (y2 - y1))"), ("highest_conf", "confidence"),
                        ("center", "-sqrt(((x1 + x2) / 2.0::DOUBLE - 960)^2 + ((y1 + y2) / 2.0::DOUBLE - 540)^2)")):
    @query(f"k1_pick_{_strategy}", "detections", "videos", sql=f"""
SELECT video_id, frame_id, det_no FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY {_key} DESC, det_no) AS rn FROM detections) q WHERE rn = 1""")
    def _(d, v, strategy=_strategy):
        return tr.pick_person(d.join(v, "video_id"), strategy).select("video_id", "frame_id", "det_no")


@query("j2_nearest_candidate", "detections", "gt_centers", sql="""
SELECT video_id, frame_id, round(dist, 6) + 0.0 AS dist, det_no, track_id FROM (
  SELECT g.video_id, g.frame_id, d.det_no, d.track_id, sqrt(((x1 + x2) / 2.0::DOUBLE - center_x)^2 + ((y1 + y2) / 2.0::DOUBLE - center_y)^2) AS dist,
         row_number() OVER (PARTITION BY g.video_id, g.frame_id ORDER BY sqrt(((x1 + x2) / 2.0::DOUBLE - center_x)^2 + ((y1 + y2) / 2.0::DOUBLE - center_y)^2), det_no) AS rn
  FROM gt_centers g JOIN detections d ON g.video_id = d.video_id AND g.frame_id = d.frame_id) q WHERE rn = 1""")
def _(d, gt):
    out = tr.nearest_candidate(gt, d, ("center_x", "center_y"))
    return out.select("video_id", "frame_id", r6(F.col("dist")).alias("dist"), "det_no", "track_id")


@query("j2_nearest_single_confident_candidate", "detections", "track", sql="""
SELECT video_id, frame_id, round(dist, 6) + 0.0 AS dist, det_no FROM (
  SELECT t.video_id, t.frame_id, d.det_no, sqrt(((d.x1 + d.x2) / 2.0::DOUBLE - t.cx)^2 + ((d.y1 + d.y2) / 2.0::DOUBLE - t.cy)^2) AS dist
  FROM track t JOIN (SELECT *, count(*) OVER (PARTITION BY video_id, frame_id) AS persons FROM detections) d
    ON t.video_id = d.video_id AND t.frame_id = d.frame_id AND d.persons = 1 AND d.confidence >= 0.5) q""")
def _(d, t):
    at = t.select("video_id", "frame_id", F.col("cx").alias("at_x"), F.col("cy").alias("at_y"))
    out = tr.nearest_candidate(at, d, ("at_x", "at_y"), min_confidence=0.5, single_only=True)
    return out.select("video_id", "frame_id", r6(F.col("dist")).alias("dist"), "det_no")


NEAR_SQL = GT_SQL + """,
near AS (
  SELECT * FROM (
    SELECT g.video_id, g.frame_id, d.det_no, d.track_id, sqrt(((x1 + x2) / 2.0::DOUBLE - center_x)^2 + ((y1 + y2) / 2.0::DOUBLE - center_y)^2) AS dist,
           row_number() OVER (PARTITION BY g.video_id, g.frame_id ORDER BY sqrt(((x1 + x2) / 2.0::DOUBLE - center_x)^2 + ((y1 + y2) / 2.0::DOUBLE - center_y)^2), det_no) AS rn
    FROM gt_dense g JOIN detections d ON g.video_id = d.video_id AND g.frame_id = d.frame_id) q WHERE rn = 1),
eval_rows AS (
  SELECT g.video_id, g.frame_id, n.dist, n.track_id, c.persons, t.track_id AS chosen_id FROM gt_dense g
  LEFT JOIN near n ON g.video_id = n.video_id AND g.frame_id = n.frame_id
  LEFT JOIN (SELECT video_id, frame_id, count(*) AS persons FROM detections GROUP BY video_id, frame_id) c ON g.video_id = c.video_id AND g.frame_id = c.frame_id
  LEFT JOIN track t ON g.video_id = t.video_id AND g.frame_id = t.frame_id),
run_rows AS (SELECT *, CASE WHEN track_id IS NOT NULL AND track_id = lag(track_id) OVER (PARTITION BY video_id ORDER BY frame_id) THEN 0 ELSE 1 END AS brk FROM eval_rows),
run_ids AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY frame_id) AS run FROM run_rows),
run_len AS (SELECT video_id, max(len) AS longest_run, sum(ids) AS ids FROM (SELECT video_id, run, count(*) AS len, count(track_id) AS ids FROM run_ids GROUP BY video_id, run) q GROUP BY video_id)"""


@query("w6_longest_same_track", "detections", "track", "frames", "gt_centers", sql=f"""
WITH {NEAR_SQL}
SELECT video_id, longest_run, round(longest_run::DOUBLE / greatest(ids, 1), 6) + 0.0 AS longest_run_ratio FROM run_len""")
def _(d, t, frames, gt):
    truth = ev.interpolate_keyframes(frames, gt, chunk=CHUNK)
    near = tr.nearest_candidate(truth, d, ("center_x", "center_y")).select("video_id", "frame_id", "track_id")
    rows = truth.select("video_id", "frame_id").join(near, ["video_id", "frame_id"], "left")
    out = tr.longest_same_track(rows, chunk=CHUNK)
    return out.withColumn("longest_run_ratio", r6(F.col("longest_run_ratio")))


@query("a8_detection_report", "detections", "track", "frames", "gt_centers", sql=f"""
WITH {NEAR_SQL}
SELECT e.video_id, count(*) AS n_evaluated, count(*) - count(dist) AS n_no_detection, round(count(dist) * 100.0::DOUBLE / count(*), 6) + 0.0 AS detection_rate,
       round(coalesce(avg(dist), 0), 6) + 0.0 AS mean_error, round(coalesce(quantile_cont(dist, 0.5), 0), 6) + 0.0 AS median_error,
       round(coalesce(stddev_pop(dist), 0), 6) + 0.0 AS std_error, round(coalesce(max(dist), 0), 6) + 0.0 AS max_error,
       round(coalesce(quantile_cont(dist, 0.9), 0), 6) + 0.0 AS p90_error, round(coalesce(quantile_cont(dist, 0.95), 0), 6) + 0.0 AS p95_error,
       round(count(*) FILTER (dist <= 50) * 100.0::DOUBLE / greatest(count(dist), 1), 6) + 0.0 AS pct_within,
       count(DISTINCT track_id) AS unique_tracks, count(*) FILTER (persons > 1) AS multi_person_frames,
       round(count(*) FILTER (persons > 1 AND chosen_id IS NOT DISTINCT FROM track_id) * 100.0::DOUBLE / greatest(count(*) FILTER (persons > 1), 1), 6) + 0.0 AS correct_person_rate,
       any_value(longest_run) AS longest_run, round(any_value(longest_run)::DOUBLE / greatest(any_value(ids), 1), 6) + 0.0 AS longest_run_ratio
FROM eval_rows e JOIN run_len r ON e.video_id = r.video_id GROUP BY e.video_id""")
def detection_report(d, t, frames, gt):
    truth = ev.interpolate_keyframes(frames, gt, chunk=CHUNK)
    out = tr.detection_report(d, t, truth, chunk=CHUNK)
    exact = {"video_id", "n_evaluated", "n_no_detection", "unique_tracks", "multi_person_frames", "longest_run"}
    return out.select(*[F.col(c) if c in exact else r6(F.col(c)).alias(c) for c in out.columns])


@query("a8_truth_track_ids", "detections", "frames", "gt_centers", sql=f"""
WITH {GT_SQL}
SELECT DISTINCT video_id, track_id FROM (
    SELECT g.video_id, d.track_id,
           row_number() OVER (PARTITION BY g.video_id, g.frame_id ORDER BY sqrt(((x1 + x2) / 2.0::DOUBLE - center_x)^2 + ((y1 + y2) / 2.0::DOUBLE - center_y)^2), det_no) AS rn
    FROM gt_dense g JOIN detections d ON g.video_id = d.video_id AND g.frame_id = d.frame_id) q WHERE rn = 1 AND track_id IS NOT NULL""")
def _(d, frames, gt):
    return tr.truth_track_ids(d, ev.interpolate_keyframes(frames, gt, chunk=CHUNK))


COVER_SQL = """cover AS (
  SELECT d.video_id, track_id, count(*) AS n, min(frame_id) AS first_frame, max(frame_id) AS last_frame,
         count(*) * 100.0::DOUBLE / any_value(n_frames) AS pct_of_video
  FROM detections d JOIN videos v ON d.video_id = v.video_id WHERE track_id IS NOT NULL GROUP BY d.video_id, track_id)"""


@query("a12_track_coverage", "detections", "videos", sql=f"""
WITH {COVER_SQL} SELECT video_id, track_id, n, first_frame, last_frame, round(pct_of_video, 6) + 0.0 AS pct_of_video FROM cover""")
def _(d, v):
    return tr.track_coverage(d, v).withColumn("pct_of_video", r6(F.col("pct_of_video")))


@query("a12_min_length_impact", "detections", "videos", sql=f"""
WITH {COVER_SQL}
SELECT video_id, m.min_length::BIGINT AS min_length, count(*) FILTER (n < m.min_length) AS ignored, count(*) FILTER (n >= m.min_length) AS kept,
       coalesce(sum(n) FILTER (n < m.min_length), 0)::BIGINT AS lost_detections,
       round(coalesce(sum(n) FILTER (n < m.min_length), 0) * 100.0::DOUBLE / sum(n), 6) + 0.0 AS pct_lost
FROM cover CROSS JOIN (VALUES (5), (10), (15), (20), (25), (30), (50)) m(min_length) GROUP BY video_id, m.min_length""")
def _(d, v):
    return tr.min_length_impact(tr.track_coverage(d, v)).withColumn("pct_lost", r6(F.col("pct_lost")))


@query("k7_longest_tracks", "detections", "videos", sql=f"""
WITH {COVER_SQL}
SELECT video_id, track_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, track_id) AS rank FROM cover) q WHERE rank <= 5""")
def _(d, v):
    return tr.longest_tracks(tr.track_coverage(d, v), 5).select("video_id", "track_id", "n", F.col("rank").cast("long").alias("rank"))


@query("a13_fragmentation", "detections", sql="""
WITH seen AS (SELECT video_id, track_id, frame_id, count(*) AS c FROM detections WHERE track_id IS NOT NULL GROUP BY ALL),
s AS (SELECT *, frame_id - lag(frame_id) OVER (PARTITION BY video_id, track_id ORDER BY frame_id) AS step FROM seen)
SELECT video_id, track_id, sum(c)::BIGINT AS n, max(frame_id) - min(frame_id) + 1 AS span, coalesce(max(step) FILTER (step > 1), 0) AS max_gap, count(*) FILTER (step > 1) AS n_gaps
FROM s GROUP BY video_id, track_id""")
def _(d):
    return tr.fragmentation(d, chunk=CHUNK)


@query("a13_person_counts", "detections", "frames", sql="""
SELECT f.video_id, count(*) FILTER (coalesce(c, 0) = 0) AS none, count(*) FILTER (c = 1) AS one, count(*) FILTER (c >= 2) AS several
FROM frames f LEFT JOIN (SELECT video_id, frame_id, count(*) AS c FROM detections GROUP BY ALL) d ON f.video_id = d.video_id AND f.frame_id = d.frame_id GROUP BY f.video_id""")
def _(d, frames):
    return tr.person_count_histogram(d, frames)


@query("a13_confidence_profile", "detections", sql="""
SELECT video_id, count(*) AS n, min(confidence) AS min, max(confidence) AS max,
       list_sort(list(confidence))[(count(*) // 10 + 1)::INT] AS p10, list_sort(list(confidence))[(count(*) // 2 + 1)::INT] AS p50, list_sort(list(confidence))[(count(*) * 9 // 10 + 1)::INT] AS p90,
       count(*) FILTER (confidence < 0.5 AND confidence >= 0.4) AS extra_40, count(*) FILTER (confidence < 0.5 AND confidence >= 0.3) AS extra_30,
       count(*) FILTER (confidence < 0.5 AND confidence >= 0.25) AS extra_25, count(*) FILTER (confidence < 0.5 AND confidence >= 0.2) AS extra_20,
       count(*) FILTER (confidence < 0.5 AND confidence >= 0.15) AS extra_15, count(*) FILTER (confidence < 0.5 AND confidence >= 0.1) AS extra_10
FROM detections GROUP BY video_id""")
def _(d):
    return tr.confidence_profile(d)


@query("a14_truth_proximity", "detections", "frames", "gt_centers", sql=f"""
WITH {GT_SQL}, dd AS (
  SELECT d.video_id, d.track_id, sqrt(((x1 + x2) / 2.0::DOUBLE - center_x)^2 + ((y1 + y2) / 2.0::DOUBLE - center_y)^2) AS dist
  FROM detections d JOIN gt_dense g ON d.video_id = g.video_id AND d.frame_id = g.frame_id WHERE d.track_id IS NOT NULL),
s AS (SELECT video_id, track_id, avg(dist) AS avg_dist, avg(CASE WHEN dist < 50 THEN 100.0::DOUBLE ELSE 0 END) AS pct_near, count(*) AS overlap, quantile_cont(dist, 0.5) AS median_dist FROM dd GROUP BY ALL)
SELECT video_id, track_id, round(avg_dist, 6) + 0.0 AS avg_dist, round(pct_near, 6) + 0.0 AS pct_near, overlap, round(median_dist, 6) + 0.0 AS median_dist,
       row_number() OVER (PARTITION BY video_id ORDER BY avg_dist, track_id) AS rank FROM s""")
def _(d, frames, gt):
    out = tr.truth_proximity(d, ev.interpolate_keyframes(frames, gt, chunk=CHUNK))
    return out.select("video_id", "track_id", "overlap", "rank", *_r6(out, "avg_dist", "pct_near", "median_dist"))


@query("u2_swing_tracks", "detections", "videos", sql=f"""
WITH {SCORED_SQL}, lo AS (SELECT video_id, track_id FROM scored WHERE n >= 10 AND score >= 0.45), hi AS (
  SELECT video_id, track_id FROM (SELECT *, max(score) OVER (PARTITION BY video_id) AS top, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, first_key) AS rn FROM scored WHERE n >= 10) q
  WHERE score >= 0.52 OR (top < 0.52 AND rn = 1))
SELECT * FROM lo EXCEPT SELECT * FROM hi""")
def _(d, v):
    competing = tr.competing_tracks(tr.track_scores(d, v))
    low = tr.select_tracks(competing, tr.SelectionParams(threshold=0.45))
    return tr.swing_tracks(low, tr.select_tracks(competing, tr.SelectionParams(threshold=0.52)))
