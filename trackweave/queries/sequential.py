"""Queries: folds over frames and the whole tracking program."""

from pyspark.sql import functions as F

from trackweave.functions import motion as mo
from trackweave.functions.geometry import r6
from trackweave.operators import sequential as sq
from trackweave.operators.series import halo_window
from trackweave.plans import tracking as plan
from trackweave.queries.accuracy import CHUNK
from trackweave.queries.motion import centred, rounded
from trackweave.queries.registry import query
from trackweave.queries.tracks import PARAMS

TRACK = plan.TrackParams(selection=PARAMS)


@query("p15_velocity_consistency", "dense", sql="""
WITH c AS (SELECT video_id, frame_id, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy FROM dense),
v AS (SELECT video_id, frame_id, cx - lag(cx) OVER w AS vx, cy - lag(cy) OVER w AS vy FROM c WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)),
h AS (SELECT *, list_filter(list(vx) OVER p, lambda q: q IS NOT NULL) AS hx, list_filter(list(vy) OVER p, lambda q: q IS NOT NULL) AS hy FROM v WINDOW p AS (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, len(hx) AS n, list_sum(list_transform(hx, lambda q, i: q * i)) / (len(hx) * (len(hx) + 1) / 2.0::DOUBLE) AS px, list_sum(list_transform(hy, lambda q, i: q * i)) / (len(hy) * (len(hy) + 1) / 2.0::DOUBLE) AS py FROM h WHERE vx IS NOT NULL),
g AS (SELECT *, sqrt(px^2 + py^2) AS p, sqrt(vx^2 + vy^2) AS c FROM m)
SELECT video_id, frame_id, round(CASE WHEN n IS NULL OR n < 3 THEN 0.5 ELSE
   0.65 * CASE WHEN p < 1e-6 OR c < 1e-6 THEN CASE WHEN p > 2 AND c < 1 THEN 0 ELSE 0.5 END ELSE greatest(0, ((px * vx + py * vy) / (p * c) + 1) / 2) END
 + 0.35 * CASE WHEN p < 1e-6 THEN CASE WHEN c < 2 THEN 1 ELSE greatest(0, 1 - c / 50) END ELSE greatest(0, 1 - abs(c - p) / (p + 1e-6)) END END, 6) + 0.0 AS score FROM g""")
def _(dense):
    moved = halo_window(centred(dense), lambda w: {"vx": F.col("cx") - F.lag("cx").over(w), "vy": F.col("cy") - F.lag("cy").over(w)}, before=1, chunk=CHUNK)
    entry = F.when(F.col("vx").isNotNull(), F.struct("vx", "vy"))
    past = halo_window(moved, lambda w: {"past": F.collect_list(entry).over(w.rowsBetween(-5, -1))}, before=5, chunk=CHUNK)
    return past.where("vx IS NOT NULL").select("video_id", "frame_id", r6(mo.velocity_consistency("past", "vx", "vy")).alias("score"))


@query("p16_size_consistency", "dense", sql="""
WITH a AS (SELECT video_id, frame_id, greatest(1.0::DOUBLE, ((x2 - x1) * (y2 - y1))::DOUBLE) AS area FROM dense),
m AS (SELECT *, avg(area) OVER p AS mean_area, count(*) OVER p AS n FROM a WINDOW p AS (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
SELECT video_id, frame_id, round(CASE WHEN n < 5 THEN 0.5 ELSE exp(-0.5 * ln(area / mean_area)^2 / 0.25) END, 6) + 0.0 AS score FROM m""")
def _(dense):
    area = F.greatest(F.lit(1.0), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("double"))
    past = halo_window(dense.withColumn("area", area), lambda w: {
        "mean_area": F.avg("area").over(w.rowsBetween(-50, -1)), "n": F.count("area").over(w.rowsBetween(-50, -1))}, before=50, chunk=CHUNK)
    return past.select("video_id", "frame_id", r6(mo.size_consistency("area", "mean_area", "n")).alias("score"))


@query("q2_identity_guard_previous", "track", sql="""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS rn FROM track),
g AS (SELECT video_id, frame_id, rn, cx AS ax, cy AS ay, NULL::DOUBLE AS prev_dist, true AS accepted FROM o WHERE rn = 1
  UNION ALL SELECT o.video_id, o.frame_id, o.rn, CASE WHEN sqrt((o.cx - ax)^2 + (o.cy - ay)^2) > 100 THEN ax ELSE o.cx END, CASE WHEN sqrt((o.cx - ax)^2 + (o.cy - ay)^2) > 100 THEN ay ELSE o.cy END,
    sqrt((o.cx - ax)^2 + (o.cy - ay)^2), sqrt((o.cx - ax)^2 + (o.cy - ay)^2) <= 100 FROM g JOIN o ON g.video_id = o.video_id AND o.rn = g.rn + 1)
SELECT video_id, frame_id, round(prev_dist, 6) + 0.0 AS prev_dist, accepted FROM g""")
def _(track):
    return rounded(sq.guard_identity(track.drop("cx", "cy"), None, max_jump=100.0, piece=CHUNK), "prev_dist").select("video_id", "frame_id", "prev_dist", "accepted")


GUARD_SQL = """o AS (SELECT t.*, sqrt((cx - trace_x)^2 + (cy - trace_y)^2) AS of_dist, row_number() OVER (PARTITION BY t.video_id ORDER BY t.frame_id) AS rn FROM track t JOIN trace r ON t.video_id = r.video_id AND t.frame_id = r.frame_id),
g AS (SELECT video_id, frame_id, rn, CASE WHEN of_dist <= 60 THEN cx END AS ax, CASE WHEN of_dist <= 60 THEN cy END AS ay, of_dist, NULL::DOUBLE AS prev_dist, of_dist <= 60 AS accepted FROM o WHERE rn = 1
  UNION ALL SELECT video_id, frame_id, rn, CASE WHEN ok THEN cx ELSE ax END, CASE WHEN ok THEN cy ELSE ay END, of_dist, d, ok FROM (
    SELECT o.*, ax, ay, sqrt((o.cx - ax)^2 + (o.cy - ay)^2) AS d, NOT (o.of_dist > 60 AND coalesce(sqrt((o.cx - ax)^2 + (o.cy - ay)^2) > 30, true)) AS ok FROM g JOIN o ON g.video_id = o.video_id AND o.rn = g.rn + 1) s)"""


@query("q3_identity_guard_with_trace", "track", "trace", sql=f"""
WITH RECURSIVE {GUARD_SQL} SELECT video_id, frame_id, round(of_dist, 6) + 0.0 AS of_dist, round(prev_dist, 6) + 0.0 AS prev_dist, accepted FROM g""")
def _(track, trace):
    out = sq.guard_identity(track.drop("cx", "cy"), trace, max_jump=60.0, piece=CHUNK)
    return rounded(out, "of_dist", "prev_dist").select("video_id", "frame_id", "of_dist", "prev_dist", "accepted")


@query("a6_guard_report", "track", "trace", sql=f"""
WITH RECURSIVE {GUARD_SQL}, l AS (SELECT video_id, 'of_dist' AS kind, of_dist AS d FROM g UNION ALL SELECT video_id, 'prev_dist', prev_dist FROM g
  UNION ALL SELECT video_id, 'rejected_of_dist', CASE WHEN NOT accepted THEN of_dist END FROM g UNION ALL SELECT video_id, 'rejected_prev_dist', CASE WHEN NOT accepted THEN prev_dist END FROM g),
c AS (SELECT video_id, count(*) FILTER (NOT accepted) AS rejections, count(*) FILTER (of_dist > 60) AS over_max, count(*) FILTER (prev_dist > 30) AS over_prev FROM g GROUP BY video_id)
SELECT l.video_id, kind, count(d) AS count, round(avg(d), 6) + 0.0 AS mean, round(quantile_cont(d, 0.5), 6) + 0.0 AS p50, round(quantile_cont(d, 0.9), 6) + 0.0 AS p90, round(quantile_cont(d, 0.95), 6) + 0.0 AS p95,
  round(max(d), 6) + 0.0 AS max, any_value(rejections) AS rejections, any_value(over_max) AS over_max, any_value(over_prev) AS over_prev FROM l JOIN c ON l.video_id = c.video_id GROUP BY l.video_id, kind""")
def _(track, trace):
    guarded = sq.guard_identity(track.drop("cx", "cy"), trace, max_jump=60.0, piece=CHUNK)
    return rounded(sq.guard_report(guarded, max_jump=60.0, with_trace=True), "mean", "p50", "p90", "p95", "max")


@query("q6_exponential_smoothing", "dense", sql="""
WITH RECURSIVE d AS (SELECT *, max(frame_id) OVER (PARTITION BY video_id) AS last FROM dense),
f AS (SELECT video_id, frame_id, x1::DOUBLE AS a, y2::DOUBLE AS b FROM d WHERE frame_id = 0
  UNION ALL SELECT d.video_id, d.frame_id, x1 / 3.0::DOUBLE + 2.0::DOUBLE / 3 * a, y2 / 3.0::DOUBLE + 2.0::DOUBLE / 3 * b FROM f JOIN d ON f.video_id = d.video_id AND d.frame_id = f.frame_id + 1),
r AS (SELECT video_id, frame_id, x1::DOUBLE AS a, y2::DOUBLE AS b FROM d WHERE frame_id = last
  UNION ALL SELECT d.video_id, d.frame_id, x1 / 3.0::DOUBLE + 2.0::DOUBLE / 3 * a, y2 / 3.0::DOUBLE + 2.0::DOUBLE / 3 * b FROM r JOIN d ON r.video_id = d.video_id AND d.frame_id = r.frame_id - 1)
SELECT f.video_id, f.frame_id, round((f.a + r.a) / 2, 6) + 0.0 AS x1, round((f.b + r.b) / 2, 6) + 0.0 AS y2 FROM f JOIN r ON f.video_id = r.video_id AND f.frame_id = r.frame_id""")
def _(dense):
    out = sq.smooth_ema(dense.select("video_id", "frame_id", "x1", "y2"), 5, columns=("x1", "y2"), chunk=CHUNK, rounded=False)
    return rounded(out, "x1", "y2")


@query("k11_trace_seed", "detections", sql="""
WITH f AS (SELECT video_id, min(frame_id) AS f FROM detections GROUP BY video_id), s AS (SELECT d.video_id, min(frame_id) AS stop FROM detections d JOIN f ON d.video_id = f.video_id WHERE frame_id > f.f + 50 GROUP BY d.video_id),
r AS (SELECT d.*, row_number() OVER (PARTITION BY d.video_id ORDER BY confidence DESC, frame_id, det_no) AS rn FROM detections d LEFT JOIN s ON d.video_id = s.video_id WHERE s.stop IS NULL OR d.frame_id <= s.stop)
SELECT video_id, frame_id AS seed_frame, (x1 + x2) / 2.0::DOUBLE AS seed_x, (y1 + y2) / 2.0::DOUBLE AS seed_y FROM r WHERE rn = 1""")
def _(detections):
    return sq.trace_seed(detections)


@query("q1_conflict_resolution", "detections", "videos", "camera_flow")
def resolved(detections, videos, flow):
    return plan.choose_observations(detections, videos, flow, TRACK, chunk=CHUNK)[0]


@query("a19_conflict_summary", "detections", "videos", "camera_flow")
def _(detections, videos, flow):
    return sq.conflict_summary(resolved(detections, videos, flow))


SEED_SQL = """seed_first AS (SELECT video_id, min(frame_id) AS f FROM detections GROUP BY video_id),
seed_stop AS (SELECT d.video_id, min(frame_id) AS stop FROM detections d JOIN seed_first f ON d.video_id = f.video_id WHERE frame_id > f.f + 50 GROUP BY d.video_id),
seed AS (SELECT video_id, frame_id AS seed_frame, (x1 + x2) / 2.0::DOUBLE AS seed_x, (y1 + y2) / 2.0::DOUBLE AS seed_y FROM (
  SELECT d.*, row_number() OVER (PARTITION BY d.video_id ORDER BY confidence DESC, frame_id, det_no) AS rn FROM detections d LEFT JOIN seed_stop s ON d.video_id = s.video_id WHERE s.stop IS NULL OR d.frame_id <= s.stop) WHERE rn = 1)"""
STEPS_SQL = """steps AS (SELECT f.video_id, f.frame_id, img_w, img_h, coalesce(a.dx, 0) AS dx, coalesce(a.dy, 0) AS dy, coalesce(-b.dx, 0) AS back_dx, coalesce(-b.dy, 0) AS back_dy
  FROM frames f JOIN videos v ON f.video_id = v.video_id LEFT JOIN camera_flow a ON f.video_id = a.video_id AND f.frame_id = a.frame_id LEFT JOIN camera_flow b ON f.video_id = b.video_id AND f.frame_id + 1 = b.frame_id)"""


def _carried_sql(name: str, seed: str, way: str) -> str:
    """The trace from a seed along the flow, forwards (+) or backwards (-), a frame at a time."""
    dx, dy = ("dx", "dy") if way == "+" else ("back_dx", "back_dy")
    return f"""{name} AS (SELECT video_id, seed_frame AS frame_id, seed_x::DOUBLE AS x, seed_y::DOUBLE AS y FROM {seed}
  UNION ALL SELECT s.video_id, s.frame_id, greatest(0, least(p.x + {dx}, img_w - 1)), greatest(0, least(p.y + {dy}, img_h - 1)) FROM {name} p JOIN steps s ON s.video_id = p.video_id AND s.frame_id = p.frame_id {way} 1)"""


@query("q4_reanchored_flow_trace", "detections", "videos", "frames", "camera_flow", sql=f"""
WITH RECURSIVE {SEED_SQL}, {STEPS_SQL},
people AS (SELECT video_id, frame_id, list({{'cx': (x1 + x2) / 2.0::DOUBLE, 'cy': (y1 + y2) / 2.0::DOUBLE}} ORDER BY det_no) AS cs FROM detections GROUP BY video_id, frame_id),
ahead AS (SELECT video_id, seed_frame AS frame_id, seed_x::DOUBLE AS x, seed_y::DOUBLE AS y, 0.0::DOUBLE AS drift, 0 AS since FROM seed
  UNION ALL SELECT video_id, frame_id, CASE WHEN hit THEN n.cx ELSE x END, CASE WHEN hit THEN n.cy ELSE y END, CASE WHEN hit THEN 0 ELSE drift END, CASE WHEN hit THEN 0 ELSE since END FROM (
    SELECT *, coalesce(n.d < 150 AND (since >= 5 OR drift > 150), false) AS hit FROM (
      SELECT *, list_sort(list_transform(cs, lambda c, i: {{'d': sqrt((c.cx - x)^2 + (c.cy - y)^2), 'i': i, 'cx': c.cx, 'cy': c.cy}}))[1] AS n FROM (
        SELECT s.video_id, s.frame_id, cs, greatest(0, least(p.x + dx, img_w - 1)) AS x, greatest(0, least(p.y + dy, img_h - 1)) AS y, p.drift + sqrt(dx^2 + dy^2) AS drift, p.since + 1 AS since
        FROM ahead p JOIN steps s ON s.video_id = p.video_id AND s.frame_id = p.frame_id + 1 LEFT JOIN people c ON c.video_id = s.video_id AND c.frame_id = s.frame_id) m) k) h),
{_carried_sql("behind", "seed", "-")}
SELECT video_id, frame_id, round(x, 6) + 0.0 AS trace_x, round(y, 6) + 0.0 AS trace_y FROM ahead
UNION ALL SELECT b.video_id, b.frame_id, round(x, 6) + 0.0, round(y, 6) + 0.0 FROM behind b JOIN seed s ON b.video_id = s.video_id AND b.frame_id < s.seed_frame""")
def _(detections, videos, frames, flow):
    spine = frames.join(videos, "video_id")
    return rounded(sq.flow_trace(spine, flow, sq.trace_seed(detections), detections, piece=CHUNK), "trace_x", "trace_y")


@query("q10_bidirectional_trace", "detections", "videos", "frames", "camera_flow", "trace", sql=f"""
WITH RECURSIVE {STEPS_SQL},
lone AS (SELECT video_id, frame_id, any_value((x1 + x2) / 2.0::DOUBLE) AS x, any_value((y1 + y2) / 2.0::DOUBLE) AS y FROM detections GROUP BY video_id, frame_id HAVING count(*) = 1),
last_lone AS (SELECT video_id, max(frame_id) AS seed_frame, max_by(x, frame_id) AS seed_x, max_by(y, frame_id) AS seed_y FROM lone GROUP BY video_id),
{_carried_sql("ahead", "last_lone", "+")},
{_carried_sql("behind", "last_lone", "-")},
pure AS (SELECT * FROM ahead UNION ALL SELECT b.* FROM behind b JOIN last_lone s ON b.video_id = s.video_id AND b.frame_id < s.seed_frame)
SELECT t.video_id, t.frame_id, round(CASE WHEN p.x IS NULL THEN trace_x ELSE (trace_x + p.x) / 2 END, 6) + 0.0 AS trace_x, round(CASE WHEN p.y IS NULL THEN trace_y ELSE (trace_y + p.y) / 2 END, 6) + 0.0 AS trace_y
FROM trace t LEFT JOIN pure p ON t.video_id = p.video_id AND t.frame_id = p.frame_id""")
def _(detections, videos, frames, flow, trace):
    spine = frames.join(videos, "video_id")
    return rounded(sq.bidirectional_trace(spine, flow, trace, detections), "trace_x", "trace_y")


@query("q5_flow_gap_fill", "track", "videos", "camera_flow")
def _(track, videos, flow):
    out = sq.fill_by_flow(track, videos, flow, sq.FlowFillParams(min_gap=2, drift_guard=60.0), chunk=CHUNK)
    return out.select("video_id", "frame_id", "x1", "y1", "x2", "y2", "fill", "flow_vx", "flow_vy", "detected", "interpolated")


@query("q7_kalman_smoothing", "track", "videos", "camera_flow")
def _(track, videos, flow):
    filled = sq.fill_by_flow(track, videos, flow, sq.FlowFillParams(min_gap=2), chunk=CHUNK)
    return sq.smooth_kalman(filled)


@query("q9_map_point_smoothing", "venue_matches", "frames", sql="""
WITH RECURSIVE points AS (SELECT f.video_id, f.frame_id, athlete_vx AS zx, athlete_vy AS zy FROM frames f LEFT JOIN venue_matches m ON f.video_id = m.video_id AND f.frame_id = m.frame_id),
seed AS (SELECT video_id, min_by(zx, frame_id) AS x, min_by(zy, frame_id) AS y FROM points WHERE zx IS NOT NULL GROUP BY video_id),
f AS (SELECT video_id, -1::BIGINT AS frame_id, x::DOUBLE AS x, 0.0::DOUBLE AS u, y::DOUBLE AS y, 0.0::DOUBLE AS v, 100.0::DOUBLE AS a, 0.0::DOUBLE AS b, 100.0::DOUBLE AS c FROM seed
  UNION ALL SELECT video_id, frame_id, x + k * (coalesce(zx, x) - x), u + l * (coalesce(zx, x) - x), y + k * (coalesce(zy, y) - y), v + l * (coalesce(zy, y) - y), a - k * a, b - k * b, c - l * b FROM (
    SELECT *, CASE WHEN zx IS NULL THEN 0 ELSE a / (a + 5) END AS k, CASE WHEN zx IS NULL THEN 0 ELSE b / (a + 5) END AS l FROM (
      SELECT p.video_id, p.frame_id, zx, zy, x + u AS x, u, y + v AS y, v, a + 2 * b + c + 1 AS a, b + c AS b, c + 1 AS c FROM f JOIN points p ON p.video_id = f.video_id AND p.frame_id = f.frame_id + 1) s) t)
SELECT video_id, frame_id, round(x, 6) + 0.0 AS venue_x, round(y, 6) + 0.0 AS venue_y FROM f WHERE frame_id >= 0""")
def _(matches, frames):
    points = frames.join(matches.select("video_id", "frame_id", F.col("athlete_vx").alias("venue_x"), F.col("athlete_vy").alias("venue_y")), ["video_id", "frame_id"], "left")
    return rounded(sq.smooth_points(points, chunk=CHUNK), "venue_x", "venue_y")


@query("s18_passthrough_track", "detections", "videos", sql="""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY greatest(1, (x2 - x1) * (y2 - y1)) DESC, det_no) AS rn FROM detections),
f AS (SELECT v.video_id, v.img_w, v.img_h, s.frame_id FROM videos v, LATERAL (SELECT unnest(range(v.n_frames)) AS frame_id) s)
SELECT f.video_id, f.frame_id::BIGINT AS frame_id, coalesce(x1, 0) AS x1, coalesce(y1, 0) AS y1, coalesce(x2, img_w) AS x2, coalesce(y2, img_h) AS y2, coalesce(confidence, 0) AS confidence, x1 IS NOT NULL AS detected, false AS interpolated
FROM f LEFT JOIN p ON f.video_id = p.video_id AND f.frame_id = p.frame_id AND rn = 1""")
def _(detections, videos):
    return plan.passthrough(detections, videos)


@query("tracking_without_flow", "detections", "videos")
def _(detections, videos):
    return plan.track_videos(detections, videos, None, TRACK)


@query("tracking_with_flow_and_guard", "detections", "videos", "camera_flow")
def _(detections, videos, flow):
    return plan.track_videos(detections, videos, flow, plan.TrackParams(selection=PARAMS, guard=True, bidirectional=True))


@query("a16_track_velocity_stats", "track", "videos", "camera_flow")
def _(track, videos, flow):
    smooth = sq.smooth_kalman(sq.fill_by_flow(track, videos, flow, chunk=CHUNK))
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    return smooth.groupBy("video_id").agg(F.avg(speed).alias("mean_speed"), F.max(speed).alias("max_speed"), F.avg("vy").alias("mean_vy"))
