"""Queries: gap filling, velocity, flow, traces and smoothness."""

from pyspark.sql import functions as F

from trackweave.functions import geometry as g
from trackweave.functions.geometry import r6, settled
from trackweave.operators import evaluate as ev
from trackweave.operators import gapfill as gf
from trackweave.operators import kinematics as kin
from trackweave.queries.accuracy import CHUNK, ERR_SQL
from trackweave.queries.registry import query

V = kin.VelocityParams(smooth_window=5, jump_vy=3.0, min_airtime=5)


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


def centred(df):
    return df.withColumns({"cx": (F.col("x1") + F.col("x2")) / F.lit(2.0), "cy": (F.col("y1") + F.col("y2")) / F.lit(2.0)})


def img(df):
    return df.withColumns({"img_w": F.lit(1920).cast("long"), "img_h": F.lit(1080).cast("long")})


@query("w13_linear_gap_fill", "track", "videos", "dense", sql="""
SELECT video_id, frame_id, x1, y1, x2, y2, detected, interpolated, gap_len FROM dense""")
def _(track, videos, _dense):
    return gf.fill_linear(track, videos, chunk=CHUNK).select(
        "video_id", "frame_id", "x1", "y1", "x2", "y2", "detected", "interpolated", "gap_len")


@query("w14_short_gap_or_flow", "track", "videos", "frames", "dense", sql="""
WITH gaps AS (SELECT d.video_id, d.frame_id, d.fa, d.fb, (d.frame_id - d.fa)::DOUBLE / (d.fb - d.fa) AS t,
       a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
       a.x1 + (d.frame_id - d.fa) * 9 AS fx1, a.y1 + (d.frame_id - d.fa) * 7 AS fy1, a.x2 + (d.frame_id - d.fa) * 9 AS fx2, a.y2 + (d.frame_id - d.fa) * 7 AS fy2
  FROM dense d JOIN track a ON a.video_id = d.video_id AND a.frame_id = d.fa JOIN track b ON b.video_id = d.video_id AND b.frame_id = d.fb WHERE d.fa <> d.fb),
s AS (SELECT *, CASE WHEN fb - fa - 1 < 2 THEN 'line'
         WHEN sqrt(((fx1 + fx2) / 2.0::DOUBLE - (ax1 + t * (bx1 - ax1) + (ax2 - ax1) / 2.0::DOUBLE))^2 + ((fy1 + fy2) / 2.0::DOUBLE - (ay1 + t * (by1 - ay1) + (ay2 - ay1) / 2.0::DOUBLE))^2) > 60
         THEN 'guarded' ELSE 'flow' END AS fill FROM gaps),
l AS (SELECT *, greatest(0, least(round_even(ax1 + t * (bx1 - ax1), 0), 1919))::BIGINT AS lx1, greatest(0, least(round_even(ay1 + t * (by1 - ay1), 0), 1079))::BIGINT AS ly1,
             round_even(ax2 + t * (bx2 - ax2), 0) AS rx2, round_even(ay2 + t * (by2 - ay2), 0) AS ry2 FROM s)
SELECT video_id, frame_id, fill, CASE WHEN fill = 'flow' THEN fx1 ELSE lx1 END AS x1, CASE WHEN fill = 'flow' THEN fy1 ELSE ly1 END AS y1,
       CASE WHEN fill = 'flow' THEN fx2 ELSE greatest(lx1 + 1, least(rx2, 1920))::BIGINT END AS x2, CASE WHEN fill = 'flow' THEN fy2 ELSE greatest(ly1 + 1, least(ry2, 1080))::BIGINT END AS y2 FROM l""")
def _(track, videos, _frames, _dense):
    rows = gf.around_gaps(track, videos, chunk=CHUNK)
    a, b = F.col("_a"), F.col("_b")
    gaps = rows.where(a["frame_id"] != b["frame_id"])
    step = F.col("frame_id") - a["frame_id"]
    gaps = gaps.withColumns({"fx1": a["x1"] + step * 9, "fy1": a["y1"] + step * 7, "fx2": a["x2"] + step * 9, "fy2": a["y2"] + step * 7})
    return gf.short_gap_or_flow(gaps, min_gap=2, drift_guard=60.0).select("video_id", "frame_id", "fill", "x1", "y1", "x2", "y2")


@query("p5_shift_and_clamp", "dense", "camera_flow", sql="""
WITH s AS (SELECT d.video_id, d.frame_id, round_even(x1 + dx * 400, 0)::BIGINT AS a, round_even(y1 + dy * 400, 0)::BIGINT AS b,
                  round_even(x2 + dx * 400, 0)::BIGINT AS c, round_even(y2 + dy * 400, 0)::BIGINT AS d
           FROM dense d JOIN camera_flow f ON d.video_id = f.video_id AND d.frame_id = f.frame_id),
l AS (SELECT *, greatest(0, least(a, 1919)) AS x1, greatest(0, least(b, 1079)) AS y1 FROM s)
SELECT video_id, frame_id, x1, y1, greatest(x1 + 1, least(c, 1920)) AS x2, greatest(y1 + 1, least(d, 1080)) AS y2 FROM l""")
def _(dense, flow):
    big = flow.select("video_id", "frame_id", (F.col("dx") * 400).alias("dx"), (F.col("dy") * 400).alias("dy"))
    return gf.shifted(img(dense).join(big, ["video_id", "frame_id"])).select("video_id", "frame_id", "x1", "y1", "x2", "y2")


@query("p6_crop_fixed", "dense", sql="""
WITH c AS (SELECT video_id, frame_id, greatest(0, least(round_even((x1 + x2) / 2.0::DOUBLE - 960, 0), 0))::BIGINT AS a,
                  greatest(0, least(round_even((y1 + y2) / 2.0::DOUBLE - 320, 0), 440))::BIGINT AS b FROM dense)
SELECT video_id, frame_id, a AS crop_x1, b AS crop_y1, a + 1920 AS crop_x2, b + 640 AS crop_y2 FROM c""")
def _(dense):
    out = gf.with_crop(img(dense), width=2400, height=640)
    return out.select("video_id", "frame_id", *[F.col(f"crop_{c}").cast("long").alias(f"crop_{c}") for c in gf.BOX])


PAD_SQL = """padded AS (
  SELECT *, greatest(0, x1 - trunc((x2 - x1) * 0.2::DOUBLE)::BIGINT) AS crop_x1, greatest(0, y1 - trunc((y2 - y1) * 0.2::DOUBLE)::BIGINT) AS crop_y1,
         least(1920, x2 + trunc((x2 - x1) * 0.2::DOUBLE)::BIGINT) AS crop_x2, least(1080, y2 + trunc((y2 - y1) * 0.2::DOUBLE)::BIGINT) AS crop_y2 FROM dense)"""


@query("p6_crop_padded", "dense", sql=f"""
WITH {PAD_SQL} SELECT video_id, frame_id, crop_x1, crop_y1, crop_x2, crop_y2 FROM padded""")
def _(dense):
    out = gf.with_crop(img(dense), padding=0.2)
    return out.select("video_id", "frame_id", *[F.col(f"crop_{c}").cast("long").alias(f"crop_{c}") for c in gf.BOX])


VEL_SQL = PAD_SQL + """,
v0 AS (SELECT p.video_id, p.frame_id, (crop_x1 + crop_x2) / 2.0::DOUBLE AS center_x, (crop_y1 + crop_y2) / 2.0::DOUBLE AS center_y,
              greatest(1.0::DOUBLE, (crop_y2 - crop_y1)::DOUBLE) AS height, coalesce(f.dx, 0) AS flow_dx, coalesce(f.dy, 0) AS flow_dy
       FROM padded p LEFT JOIN camera_flow f ON p.video_id = f.video_id AND p.frame_id = f.frame_id),
v1 AS (SELECT *, coalesce(center_x - lag(center_x) OVER w, 0) AS vel_dx, coalesce(center_y - lag(center_y) OVER w, 0) AS vel_dy FROM v0 WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)),
v2 AS (SELECT *, vel_dx - flow_dx AS comp_dx, vel_dy - flow_dy AS comp_dy, sqrt((vel_dx - flow_dx)^2 + (vel_dy - flow_dy)^2) AS speed, atan2(vel_dy - flow_dy, vel_dx - flow_dx + 1e-9) AS angle FROM v1),
v3 AS (SELECT *, sum(speed) OVER (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 AS speed_smoothed,
              coalesce(abs(atan2(sin(angle - lag(angle) OVER w), cos(angle - lag(angle) OVER w))), 0) AS turn FROM v2 WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)),
v4 AS (SELECT *, coalesce(speed_smoothed - lag(speed_smoothed) OVER (PARTITION BY video_id ORDER BY frame_id), 0) AS acceleration FROM v3),
vel AS (SELECT *, coalesce(acceleration - lag(acceleration) OVER (PARTITION BY video_id ORDER BY frame_id), 0) AS jerk FROM v4)"""


def velocity(dense, flow, params=V, chunk=CHUNK):
    return kin.velocity_table(gf.with_crop(img(dense), padding=0.2), flow, params, chunk=chunk)


def _velocity_query(name, *columns, views=("dense", "camera_flow")):
    sql = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)

    @query(name, *views, sql=f"WITH {VEL_SQL} SELECT video_id, frame_id, {sql} FROM vel")
    def _(dense, flow):
        return rounded(velocity(dense, flow), *columns).select("video_id", "frame_id", *columns)


_velocity_query("w1_pixel_velocity", "center_x", "center_y", "vel_dx", "vel_dy")
_velocity_query("w2_camera_compensation", "comp_dx", "comp_dy", "speed")
_velocity_query("w3_moving_average", "speed_smoothed")
_velocity_query("w4_acceleration_jerk", "acceleration", "jerk")
_velocity_query("p14_turning_angle", "turn")


@query("p21_height_normalised_velocity", "dense", "camera_flow", sql=f"""
WITH {VEL_SQL} SELECT video_id, frame_id, round(comp_dx / height, 6) + 0.0 AS comp_dx, round(comp_dy / height, 6) + 0.0 AS comp_dy FROM vel""")
def _(dense, flow):
    out = velocity(dense, flow, kin.VelocityParams(normalize_by_height=True))
    return rounded(out, "comp_dx", "comp_dy").select("video_id", "frame_id", "comp_dx", "comp_dy")


@query("p20_zoom_correction", "dense", "camera_flow", sql="""
WITH a AS (SELECT video_id, frame_id, (greatest(x2 - x1, 1) * greatest(y2 - y1, 1))::DOUBLE AS area FROM dense),
m AS (SELECT video_id, avg(area) AS mean_area FROM a GROUP BY video_id)
SELECT f.video_id, f.frame_id, round(dx / coalesce(sqrt(area / mean_area), 1), 6) + 0.0 AS dx, round(dy / coalesce(sqrt(area / mean_area), 1), 6) + 0.0 AS dy
FROM camera_flow f LEFT JOIN a ON f.video_id = a.video_id AND f.frame_id = a.frame_id LEFT JOIN m ON f.video_id = m.video_id""")
def _(dense, flow):
    return rounded(kin.zoom_corrected(flow, dense), "dx", "dy")


@query("a16_velocity_summary", "dense", "camera_flow", sql=f"""
WITH {VEL_SQL} SELECT video_id, round(avg(speed), 6) + 0.0 AS mean_speed, round(max(speed), 6) + 0.0 AS max_speed, round(avg(comp_dy), 6) + 0.0 AS mean_vy,
  round(1 / (avg(abs(jerk)) + 1e-6), 6) + 0.0 AS smoothness, round(avg(turn), 6) + 0.0 AS mean_curvature FROM vel GROUP BY video_id""")
def velocity_summary(dense, flow):
    return rounded(kin.velocity_summary(velocity(dense, flow)), "mean_speed", "max_speed", "mean_vy", "smoothness", "mean_curvature")


@query("w10_frame_jumps", "dense", sql="""
WITH c AS (SELECT video_id, frame_id, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy FROM dense),
j AS (SELECT *, sqrt((cx - lag(cx) OVER w)^2 + (cy - lag(cy) OVER w)^2) AS jump FROM c WINDOW w AS (PARTITION BY video_id ORDER BY frame_id))
SELECT video_id, frame_id, round(jump, 6) + 0.0 AS jump FROM j WHERE jump > 30""")
def _(dense):
    return rounded(kin.frame_jumps(centred(dense), 30.0, chunk=CHUNK), "jump").select("video_id", "frame_id", "jump")


@query("w11_cumulative_flow", "camera_flow", sql="""
SELECT video_id, frame_id, round(sum(dx) OVER w, 6) + 0.0 AS cum_dx, round(sum(dy) OVER w, 6) + 0.0 AS cum_dy FROM camera_flow WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)""")
def _(flow):
    return rounded(kin.cumulative_flow(flow, chunk=CHUNK), "cum_dx", "cum_dy").select("video_id", "frame_id", "cum_dx", "cum_dy")


@query("w12_arc_length", "track", sql="""
WITH s AS (SELECT video_id, frame_id, coalesce(sqrt((cx - lag(cx) OVER w)^2 + (cy - lag(cy) OVER w)^2), 0) AS d FROM track WINDOW w AS (PARTITION BY video_id ORDER BY frame_id))
SELECT video_id, frame_id, round(sum(d) OVER (PARTITION BY video_id ORDER BY frame_id), 4) + 0.0 AS arc FROM s""")
def _(track):
    return kin.arc_length(track, "cx", "cy", chunk=CHUNK).select("video_id", "frame_id", (settled("arc", 4)).alias("arc"))


@query("w19_running_mean_error", "track", "frames", "gt_centers", sql=f"""
WITH {ERR_SQL}
SELECT video_id, frame_id, round(avg(error) OVER (PARTITION BY video_id ORDER BY frame_id), 6) + 0.0 AS mean_so_far FROM errors WHERE error IS NOT NULL""")
def _(track, frames, gt):
    errors = ev.centre_errors(track, ev.interpolate_keyframes(frames, gt, chunk=CHUNK)).where("error IS NOT NULL")
    return rounded(kin.running_mean_error(errors, chunk=CHUNK), "mean_so_far").select("video_id", "frame_id", "mean_so_far")


@query("w20_trailing_positions", "dense", sql="""
WITH c AS (SELECT video_id, frame_id, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy FROM dense)
SELECT video_id, frame_id, count(*) OVER w AS trail_len, round(sum(cx) OVER w, 6) + 0.0 AS sum_x, round(first_value(cy) OVER w, 6) + 0.0 AS tail_y
FROM c WINDOW w AS (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def _(dense):
    t = kin.trailing_positions(centred(dense), 60, chunk=CHUNK)
    total = F.aggregate("trail", F.lit(0.0), lambda acc, p: acc + p["cx"])
    return t.select("video_id", "frame_id", F.size("trail").cast("long").alias("trail_len"), r6(total).alias("sum_x"), r6(F.col("trail")[0]["cy"]).alias("tail_y"))


@query("a23_masked_background_flow", "pixel_flow", "dense", sql="""
WITH j AS (SELECT p.*, NOT coalesce(px >= greatest(x1, 0) AND px < x2 AND py >= greatest(y1, 0) AND py < y2, false) AS outside
           FROM pixel_flow p LEFT JOIN dense d ON p.video_id = d.video_id AND p.frame_id = d.frame_id),
m AS (SELECT *, outside AND gray < 80 AND grad > 5 AS masked FROM j)
SELECT video_id, frame_id, count(*) FILTER (masked) AS n_masked, count(*) FILTER (masked) >= 6 AS used_mask,
  round(coalesce(CASE WHEN count(*) FILTER (masked) >= 6 THEN quantile_cont(dx, 0.5) FILTER (masked) ELSE quantile_cont(dx, 0.5) FILTER (outside) END, 0), 6) + 0.0 AS dx,
  round(coalesce(CASE WHEN count(*) FILTER (masked) >= 6 THEN quantile_cont(dy, 0.5) FILTER (masked) ELSE quantile_cont(dy, 0.5) FILTER (outside) END, 0), 6) + 0.0 AS dy
FROM m GROUP BY video_id, frame_id""")
def _(pixels, dense):
    return rounded(kin.masked_flow(pixels, dense, min_pixels=6), "dx", "dy")


POINT_SQL = """
f AS (SELECT video_id, frame_id, count(*) AS n_points, count(*) FILTER (ok) AS n_ok, quantile_cont(dx, 0.5) FILTER (ok) AS mdx, quantile_cont(dy, 0.5) FILTER (ok) AS mdy FROM point_tracks GROUP BY ALL),
c AS (SELECT p.*, abs(dx - mdx) AS ax, abs(dy - mdy) AS ay FROM point_tracks p JOIN f ON p.video_id = f.video_id AND p.frame_id = f.frame_id WHERE ok AND n_points >= 5 AND n_ok >= 3),
s AS (SELECT video_id, frame_id, greatest(quantile_cont(ax, 0.5), 1e-6) AS sx, greatest(quantile_cont(ay, 0.5), 1e-6) AS sy FROM c GROUP BY ALL),
i AS (SELECT c.video_id, c.frame_id, count(*) AS n_inliers, quantile_cont(dx, 0.5) AS dx, quantile_cont(dy, 0.5) AS dy FROM c JOIN s ON c.video_id = s.video_id AND c.frame_id = s.frame_id
      WHERE ax < 3 * sx AND ay < 3 * sy GROUP BY ALL),
disp AS (SELECT f.video_id, f.frame_id, n_points, coalesce(n_inliers, 0) AS n_inliers, CASE WHEN n_inliers >= 2 THEN dx ELSE 0 END AS dx, CASE WHEN n_inliers >= 2 THEN dy ELSE 0 END AS dy,
       CASE WHEN n_inliers >= 2 THEN 'sparse' ELSE 'none' END AS method FROM f LEFT JOIN i ON f.video_id = i.video_id AND f.frame_id = i.frame_id)"""


@query("a24_robust_point_displacement", "point_tracks", sql=f"""
WITH {POINT_SQL} SELECT video_id, frame_id, n_points, n_inliers, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, method FROM disp""")
def _(points):
    return rounded(kin.point_displacement(points), "dx", "dy")


@query("a35_method_summary", "point_tracks", sql=f"""
WITH {POINT_SQL}, u AS (SELECT video_id, count(DISTINCT method) FILTER (method <> 'none') AS k, max(method) FILTER (method <> 'none') AS m FROM disp GROUP BY video_id)
SELECT video_id, CASE WHEN k = 0 THEN 'none' WHEN k = 1 THEN m ELSE 'mixed' END AS method FROM u""")
def _(points):
    return kin.method_summary(kin.point_displacement(points))


DRIFT_SQL = """cen AS (SELECT video_id, frame_id, interpolated, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy FROM dense),
drift AS (SELECT c.*, sqrt((cx - trace_x)^2 + (cy - trace_y)^2) AS drift,
            sqrt((cx - lag(cx) OVER w)^2 + (cy - lag(cy) OVER w)^2) AS jump FROM cen c JOIN trace t ON c.video_id = t.video_id AND c.frame_id = t.frame_id WINDOW w AS (PARTITION BY c.video_id ORDER BY c.frame_id))"""


@query("j17_trace_drift", "dense", "trace", sql=f"""
WITH {DRIFT_SQL} SELECT video_id, frame_id, round(drift, 6) + 0.0 AS drift FROM drift""")
def _(dense, trace):
    return rounded(kin.trace_drift(centred(dense), trace), "drift").select("video_id", "frame_id", "drift")


@query("a17_drift_by_block", "dense", "trace", sql=f"""
WITH {DRIFT_SQL} SELECT video_id, frame_id // 50 AS block, round(avg(drift), 6) + 0.0 AS mean_drift, round(quantile_cont(drift, 0.5), 6) + 0.0 AS median_drift, round(max(drift), 6) + 0.0 AS max_drift,
  count(*) FILTER (interpolated) AS n_interpolated, count(*) FILTER (frame_id % 50 > 0 AND jump > 30) AS n_jumps FROM drift GROUP BY video_id, frame_id // 50""")
def _(dense, trace):
    return rounded(kin.drift_by_block(centred(dense), trace, chunk=CHUNK), "mean_drift", "median_drift", "max_drift")


@query("a18_displacement_smoothness", "dense", sql="""
WITH c AS (SELECT video_id, frame_id, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy FROM dense),
j AS (SELECT video_id, sqrt((cx - lag(cx) OVER w)^2 + (cy - lag(cy) OVER w)^2) AS d FROM c WINDOW w AS (PARTITION BY video_id ORDER BY frame_id))
SELECT video_id, round(avg(d), 6) + 0.0 AS mean, round(stddev_pop(d), 6) + 0.0 AS std, round(max(d), 6) + 0.0 AS max FROM j GROUP BY video_id""")
def _(dense):
    return rounded(kin.displacement_smoothness(centred(dense), "cx", "cy", chunk=CHUNK), "mean", "std", "max")


@query("a18_drift_summary", "dense", "trace", sql=f"""
WITH {DRIFT_SQL} SELECT video_id, count(*) AS n, round(avg(drift), 6) + 0.0 AS mean, round(quantile_cont(drift, 0.5), 6) + 0.0 AS median, round(quantile_cont(drift, 0.9), 6) + 0.0 AS p90, round(max(drift), 6) + 0.0 AS max
FROM drift GROUP BY video_id""")
def _(dense, trace):
    return rounded(kin.drift_summary(centred(dense), trace), "mean", "median", "p90", "max")


@query("j18_merge_traces", "trace", "track", sql="""
SELECT a.video_id, a.frame_id, CASE WHEN t.cx IS NULL THEN trace_x ELSE (trace_x + t.cx) / 2 END AS trace_x, CASE WHEN t.cx IS NULL THEN trace_y ELSE (trace_y + t.cy) / 2 END AS trace_y
FROM trace a LEFT JOIN track t ON a.video_id = t.video_id AND a.frame_id = t.frame_id""")
def _(trace, track):
    return kin.merge_traces(trace, track.select("video_id", "frame_id", F.col("cx").alias("trace_x"), F.col("cy").alias("trace_y")))


@query("u4_concat_traces", "trace", "track", sql="""
WITH seed AS (SELECT video_id, max(frame_id) // 2 AS s FROM track GROUP BY video_id)
SELECT t.video_id, t.frame_id, cx AS trace_x, cy AS trace_y FROM track t JOIN seed s ON t.video_id = s.video_id WHERE frame_id < s
UNION ALL SELECT t.video_id, t.frame_id, trace_x, trace_y FROM trace t JOIN seed s ON t.video_id = s.video_id WHERE frame_id >= s""")
def _(trace, track):
    seed = track.groupBy("video_id").agg(F.floor(F.max("frame_id") / 2).alias("seed_frame"))
    back = track.select("video_id", "frame_id", F.col("cx").alias("trace_x"), F.col("cy").alias("trace_y"))
    return kin.concat_traces(back, trace, seed)


@query("p13_error_bands", "track", "frames", "gt_centers", sql=f"""
WITH {ERR_SQL} SELECT video_id, frame_id, CASE WHEN error < 30 THEN 'good' WHEN error < 60 THEN 'fair' ELSE 'poor' END AS band FROM errors WHERE error IS NOT NULL""")
def _(track, frames, gt):
    errors = ev.centre_errors(track, ev.interpolate_keyframes(frames, gt, chunk=CHUNK)).where("error IS NOT NULL")
    return errors.select("video_id", "frame_id", g.band("error", (30, 60), ("good", "fair", "poor")).alias("band"))


@query("p13_speed_bands", "dense", "camera_flow", sql=f"""
WITH {VEL_SQL}, m AS (SELECT *, least(1.0::DOUBLE, speed_smoothed / max(speed_smoothed) OVER (PARTITION BY video_id)) AS ratio FROM vel)
SELECT video_id, frame_id, round(ratio, 6) + 0.0 AS ratio, CASE WHEN ratio < 0.5 THEN 'slow' ELSE 'fast' END AS band FROM m""")
def _(dense, flow):
    vel = velocity(dense, flow)
    top = vel.groupBy("video_id").agg(F.max("speed_smoothed").alias("top"))
    ratio = F.least(F.lit(1.0), F.col("speed_smoothed") / F.col("top"))
    out = vel.join(top, "video_id").withColumn("ratio", ratio)
    return out.select("video_id", "frame_id", r6(F.col("ratio")).alias("ratio"), g.band("ratio", (0.5,), ("slow", "fast")).alias("band"))
