"""Queries: agreement with annotated centres."""

from pyspark.sql import functions as F

from trackweave.functions.geometry import r6
from trackweave.operators import evaluate as ev
from trackweave.queries.registry import query

# interpolated truth in DuckDB, used by many checks
GT_SQL = """
gt_around AS (
  SELECT f.video_id, f.frame_id, f.is_frame,
         last_value(g.frame_id IGNORE NULLS) OVER a AS fa, last_value(g.center_x IGNORE NULLS) OVER a AS xa,
         last_value(g.center_y IGNORE NULLS) OVER a AS ya,
         first_value(g.frame_id IGNORE NULLS) OVER b AS fb, first_value(g.center_x IGNORE NULLS) OVER b AS xb,
         first_value(g.center_y IGNORE NULLS) OVER b AS yb
  FROM (SELECT video_id, frame_id, true AS is_frame FROM frames) f
  LEFT JOIN gt_centers g ON f.video_id = g.video_id AND f.frame_id = g.frame_id
  WINDOW a AS (PARTITION BY f.video_id ORDER BY f.frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY f.video_id ORDER BY f.frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
gt_dense AS (
  SELECT video_id, frame_id,
         CASE WHEN fa = fb THEN xa ELSE xa + (frame_id - fa)::DOUBLE / (fb - fa) * (xb - xa) END AS center_x,
         CASE WHEN fa = fb THEN ya ELSE ya + (frame_id - fa)::DOUBLE / (fb - fa) * (yb - ya) END AS center_y
  FROM gt_around WHERE fa IS NOT NULL AND fb IS NOT NULL
)"""
ERR_SQL = GT_SQL + """,
errors AS (
  SELECT g.video_id, g.frame_id, g.center_x, g.center_y, t.cx, t.cy, t.det_no,
         sqrt((t.cx - g.center_x)^2 + (t.cy - g.center_y)^2) AS error
  FROM gt_dense g LEFT JOIN track t ON g.video_id = t.video_id AND g.frame_id = t.frame_id
)"""
CHUNK = 256  # small enough that the carry between chunks is exercised on the given tables


@query("p3_distance_gate", "track", "gt_centers", sql="""
SELECT t.video_id, t.frame_id, round(sqrt((cx - center_x)^2 + (cy - center_y)^2), 6) + 0.0 AS dist,
       sqrt((cx - center_x)^2 + (cy - center_y)^2) <= 50 AS within, sqrt((cx - center_x)^2 + (cy - center_y)^2) > 30 AS jump
FROM track t JOIN gt_centers g ON t.video_id = g.video_id AND t.frame_id = g.frame_id""")
def _(track, gt):
    d = ev.centre_errors(track, gt).where("error IS NOT NULL")
    return d.select("video_id", "frame_id", r6(F.col("error")).alias("dist"),
                    (F.col("error") <= 50).alias("within"), (F.col("error") > 30).alias("jump"))


@query("j1_prediction_truth_join", "track", "frames", "gt_centers", sql=f"""
WITH {ERR_SQL}
SELECT video_id, frame_id, round(error, 6) + 0.0 AS error, error IS NULL AS missed FROM errors""")
def _(track, frames, gt):
    truth = ev.interpolate_keyframes(frames, gt, chunk=CHUNK)
    return ev.centre_errors(track, truth).select(
        "video_id", "frame_id", r6(F.col("error")).alias("error"), F.col("error").isNull().alias("missed"))


@query("j3_keyframe_interpolation", "frames", "gt_centers", sql=f"""
WITH {GT_SQL}
SELECT video_id, frame_id, round(center_x, 6) + 0.0 AS center_x, round(center_y, 6) + 0.0 AS center_y FROM gt_dense""")
def _(frames, gt):
    return ev.interpolate_keyframes(frames, gt, chunk=CHUNK).select(
        "video_id", "frame_id", r6(F.col("center_x")).alias("center_x"), r6(F.col("center_y")).alias("center_y"))


@query("j4_keyframe_interpolation_leading_fill", "frames", "gt_centers", sql=f"""
WITH {GT_SQL}
SELECT video_id, frame_id,
       round(CASE WHEN fa IS NULL THEN xb WHEN fa = fb THEN xa ELSE xa + (frame_id - fa)::DOUBLE / (fb - fa) * (xb - xa) END, 6) + 0.0 AS center_x,
       round(CASE WHEN fa IS NULL THEN yb WHEN fa = fb THEN ya ELSE ya + (frame_id - fa)::DOUBLE / (fb - fa) * (yb - ya) END, 6) + 0.0 AS center_y
FROM gt_around WHERE fb IS NOT NULL""")
def _(frames, gt):
    return ev.interpolate_with_lead(frames, gt, chunk=CHUNK).select(
        "video_id", "frame_id", r6(F.col("center_x")).alias("center_x"), r6(F.col("center_y")).alias("center_y"))


@query("a6_distance_summary", "track", "gt_centers", sql="""
SELECT video_id, count(d) AS count, round(avg(d), 6) + 0.0 AS mean, round(quantile_cont(d, 0.5), 6) + 0.0 AS p50,
       round(quantile_cont(d, 0.9), 6) + 0.0 AS p90, round(quantile_cont(d, 0.95), 6) + 0.0 AS p95, round(max(d), 6) + 0.0 AS max
FROM (SELECT t.video_id, sqrt((cx - center_x)^2 + (cy - center_y)^2) AS d
      FROM track t JOIN gt_centers g ON t.video_id = g.video_id AND t.frame_id = g.frame_id) e
GROUP BY video_id""")
def _(track, gt):
    out = ev.distance_summary(ev.centre_errors(track, gt), "error")
    return out.select("video_id", "count", *[r6(F.col(c)).alias(c) for c in ("mean", "p50", "p90", "p95", "max")])


REPORT = ("mean_error", "median_error", "std_error", "max_error", "p90_error", "p95_error", "pct_within", "detection_rate")


@query("a7_track_error_report", "track", "frames", "gt_centers", sql=f"""
WITH {ERR_SQL}
SELECT video_id, count(error) AS n_evaluated, count(*) - count(error) AS n_missed,
       round(avg(error), 6) + 0.0 AS mean_error, round(quantile_cont(error, 0.5), 6) + 0.0 AS median_error,
       round(stddev_pop(error), 6) + 0.0 AS std_error, round(max(error), 6) + 0.0 AS max_error,
       round(quantile_cont(error, 0.9), 6) + 0.0 AS p90_error, round(quantile_cont(error, 0.95), 6) + 0.0 AS p95_error,
       round(count(*) FILTER (error <= 50) * 100.0::DOUBLE / count(error), 6) + 0.0 AS pct_within,
       round(count(error) * 100.0::DOUBLE / count(*), 6) + 0.0 AS detection_rate
FROM errors GROUP BY video_id""")
def track_report(track, frames, gt):
    truth = ev.interpolate_keyframes(frames, gt, chunk=CHUNK)
    out = ev.track_error_report(track, truth)
    return out.select("video_id", "n_evaluated", "n_missed", *[r6(F.col(c)).alias(c) for c in REPORT])
