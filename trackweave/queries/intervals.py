"""Queries: jumps, stretches, episodes, interval matching and HOTA."""

from pyspark.sql import functions as F

from trackweave.functions.geometry import r6
from trackweave.functions.motion import interval_iou
from trackweave.operators import evaluate as ev
from trackweave.operators import hota as ht
from trackweave.operators import intervals as iv
from trackweave.queries.accuracy import CHUNK, ERR_SQL, GT_SQL
from trackweave.queries.motion import VEL_SQL, centred, rounded, velocity
from trackweave.queries.registry import query

JUMP_SQL = VEL_SQL + """,
seg AS (SELECT *, sum(CASE WHEN comp_dy >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_id) AS seg FROM vel),
jb AS (SELECT video_id, seg, min(frame_id) FILTER (comp_dy < -3) AS start_frame, max(frame_id) AS end_frame FROM seg WHERE comp_dy < 3 GROUP BY ALL),
jp AS (SELECT *, row_number() OVER (PARTITION BY video_id, seg ORDER BY comp_dy, frame_id) AS rn FROM seg WHERE comp_dy < 3),
jumps AS (SELECT b.video_id, start_frame, end_frame, p.frame_id AS peak_frame, end_frame - start_frame + 1 AS airtime_frames, sqrt(p.comp_dx^2 + p.comp_dy^2) AS peak_speed
          FROM jb b JOIN jp p ON b.video_id = p.video_id AND b.seg = p.seg AND p.rn = 1 WHERE end_frame - start_frame + 1 >= 2)"""


def jumps(dense, flow):
    return iv.jump_intervals(velocity(dense, flow), min_airtime=2, chunk=CHUNK)


@query("w5_jump_intervals", "dense", "camera_flow", sql=f"""
WITH {JUMP_SQL} SELECT video_id, start_frame, end_frame, peak_frame, airtime_frames, round(peak_speed, 6) + 0.0 AS peak_speed FROM jumps""")
def _(dense, flow):
    return rounded(jumps(dense, flow), "peak_speed")


@query("j6_in_jump_flag", "dense", "camera_flow", sql=f"""
WITH {JUMP_SQL} SELECT d.video_id, d.frame_id, EXISTS (SELECT 1 FROM jumps j WHERE j.video_id = d.video_id AND d.frame_id BETWEEN j.start_frame AND j.end_frame) AS in_jump FROM dense d""")
def _(dense, flow):
    return iv.flag_frames(dense.select("video_id", "frame_id"), jumps(dense, flow), "in_jump")


@query("j6_overlap_labels", "frames", "gt_jumps", "pred_jumps", sql="""
WITH l AS (SELECT f.video_id, f.frame_id, EXISTS (SELECT 1 FROM gt_jumps j WHERE j.video_id = f.video_id AND f.frame_id BETWEEN j.start_frame AND j.end_frame) AS g,
       EXISTS (SELECT 1 FROM pred_jumps j WHERE j.video_id = f.video_id AND f.frame_id BETWEEN j.start_frame AND j.end_frame) AS p FROM frames f)
SELECT video_id, frame_id, CASE WHEN g AND p THEN 'both' WHEN g THEN 'truth' WHEN p THEN 'predicted' ELSE 'none' END AS label FROM l""")
def _(frames, gt, pred):
    return iv.overlap_labels(frames, gt, pred)


PAIR_SQL = """pairs AS (
  SELECT g.video_id, g.jump_id AS gt_id, p.jump_id AS pred_id, g.start_frame AS g0, g.end_frame AS g1, p.start_frame AS p0, p.end_frame AS p1,
         (least(g.end_frame + 2, p.end_frame) - greatest(g.start_frame - 2, p.start_frame) + 1)::DOUBLE / (greatest(g.end_frame + 2, p.end_frame) - least(g.start_frame - 2, p.start_frame) + 1) AS iou
  FROM gt_jumps g JOIN pred_jumps p ON g.video_id = p.video_id AND p.start_frame <= g.end_frame + 2 AND p.end_frame >= g.start_frame - 2
  WHERE (least(g.end_frame + 2, p.end_frame) - greatest(g.start_frame - 2, p.start_frame) + 1)::DOUBLE / (greatest(g.end_frame + 2, p.end_frame) - least(g.start_frame - 2, p.start_frame) + 1) >= 0.3)"""
MATCH_SQL = PAIR_SQL + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY iou DESC, gt_id DESC, pred_id DESC) AS rn FROM pairs),
walk AS (SELECT video_id, 0::BIGINT AS rn, []::BIGINT[] AS gs, []::BIGINT[] AS ps, false AS took FROM ranked GROUP BY video_id
  UNION ALL
  SELECT w.video_id, r.rn,
         CASE WHEN NOT list_contains(gs, r.gt_id) AND NOT list_contains(ps, r.pred_id) THEN list_append(gs, r.gt_id) ELSE gs END,
         CASE WHEN NOT list_contains(gs, r.gt_id) AND NOT list_contains(ps, r.pred_id) THEN list_append(ps, r.pred_id) ELSE ps END,
         NOT list_contains(gs, r.gt_id) AND NOT list_contains(ps, r.pred_id)
  FROM walk w JOIN ranked r ON w.video_id = r.video_id AND r.rn = w.rn + 1),
matches AS (SELECT r.video_id, gt_id, pred_id, iou, abs(p0 - g0) AS start_err, abs(p1 - g1) AS end_err FROM ranked r JOIN walk w ON r.video_id = w.video_id AND r.rn = w.rn AND w.took)"""


def pairs(gt, pred):
    return iv.interval_pairs(gt, pred, min_iou=0.3, tolerance=2, bucket=512)


def matches(gt, pred):
    return iv.greedy_matches(pairs(gt, pred), chunk=CHUNK)


@query("p17_interval_iou", "gt_jumps", "pred_jumps", sql="""
SELECT g.video_id, g.jump_id, round(greatest(0, least(g.end_frame, p.end_frame) - greatest(g.start_frame, p.start_frame) + 1)::DOUBLE
       / (greatest(g.end_frame, p.end_frame) - least(g.start_frame, p.start_frame) + 1), 6) + 0.0 AS iou
FROM gt_jumps g JOIN pred_jumps p ON g.video_id = p.video_id AND g.jump_id = p.jump_id""")
def _(gt, pred):
    p = pred.select("video_id", "jump_id", F.col("start_frame").alias("p0"), F.col("end_frame").alias("p1"))
    return gt.join(p, ["video_id", "jump_id"]).select(
        "video_id", "jump_id", r6(interval_iou("start_frame", "end_frame", "p0", "p1")).alias("iou"))


@query("j5_interval_pairs", "gt_jumps", "pred_jumps", sql=f"""
WITH {PAIR_SQL} SELECT video_id, gt_id, pred_id, round(iou, 6) + 0.0 AS iou FROM pairs""")
def _(gt, pred):
    return rounded(pairs(gt, pred), "iou").select("video_id", "gt_id", "pred_id", "iou")


@query("q8_greedy_interval_matching", "gt_jumps", "pred_jumps", sql=f"""
WITH RECURSIVE {MATCH_SQL} SELECT video_id, gt_id, pred_id, round(iou, 6) + 0.0 AS iou, start_err, end_err FROM matches""")
def _(gt, pred):
    return rounded(matches(gt, pred), "iou")


JREP_SQL = MATCH_SQL + """,
rep AS (SELECT v.video_id, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(mean_iou, 0) AS mean_iou, coalesce(se, 0) AS mean_start_err, coalesce(ee, 0) AS mean_end_err
  FROM (SELECT video_id FROM gt_jumps UNION SELECT video_id FROM pred_jumps) v
  LEFT JOIN (SELECT video_id, count(*) AS n_gt FROM gt_jumps GROUP BY ALL) g ON g.video_id = v.video_id
  LEFT JOIN (SELECT video_id, count(*) AS n_pred FROM pred_jumps GROUP BY ALL) p ON p.video_id = v.video_id
  LEFT JOIN (SELECT video_id, count(*) AS tp, avg(iou) AS mean_iou, avg(start_err) AS se, avg(end_err) AS ee FROM matches GROUP BY ALL) m ON m.video_id = v.video_id)"""


@query("a10_jump_report", "gt_jumps", "pred_jumps", sql=f"""
WITH RECURSIVE {JREP_SQL} SELECT video_id, n_gt, n_pred, tp, n_pred - tp AS fp, n_gt - tp AS fn, round(coalesce(tp::DOUBLE / nullif(n_pred, 0), 0), 6) + 0.0 AS precision,
  round(coalesce(tp::DOUBLE / nullif(n_gt, 0), 0), 6) + 0.0 AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(n_gt + n_pred, 0), 0), 6) + 0.0 AS f1,
  round(mean_iou, 6) + 0.0 AS mean_iou, round(mean_start_err, 6) + 0.0 AS mean_start_err, round(mean_end_err, 6) + 0.0 AS mean_end_err FROM rep""")
def jump_report(gt, pred):
    return rounded(iv.jump_report(gt, pred, matches(gt, pred)), "precision", "recall", "f1", "mean_iou", "mean_start_err", "mean_end_err")


@query("a10_jump_report_overall", "gt_jumps", "pred_jumps", sql=f"""
WITH RECURSIVE {JREP_SQL}, o AS (SELECT sum(n_gt)::BIGINT AS n_gt, sum(n_pred)::BIGINT AS n_pred, sum(tp)::BIGINT AS tp, avg(mean_iou) AS mean_iou FROM rep WHERE n_gt > 0)
SELECT n_gt, n_pred, tp, n_pred - tp AS fp, n_gt - tp AS fn, round(tp::DOUBLE / n_pred, 6) + 0.0 AS precision, round(tp::DOUBLE / n_gt, 6) + 0.0 AS recall,
  round(2.0::DOUBLE * tp / (n_gt + n_pred), 6) + 0.0 AS f1, round(mean_iou, 6) + 0.0 AS mean_iou FROM o""")
def _(gt, pred):
    per = iv.jump_report(gt, pred, matches(gt, pred))
    return rounded(iv.jump_report_overall(per), "precision", "recall", "f1", "mean_iou")


@query("j20_missed_and_false", "gt_jumps", "pred_jumps", sql=f"""
WITH RECURSIVE {MATCH_SQL}
SELECT video_id, jump_id, 'missed' AS kind, end_frame - start_frame + 1 AS length FROM gt_jumps g WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.video_id = g.video_id AND m.gt_id = g.jump_id)
UNION ALL SELECT video_id, jump_id, 'false', end_frame - start_frame + 1 FROM pred_jumps p WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.video_id = p.video_id AND m.pred_id = p.jump_id)""")
def _(gt, pred):
    return iv.missed_and_false(gt, pred, matches(gt, pred))


STRETCH_SQL = """st0 AS (SELECT video_id, frame_id, frame_id - row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS k FROM dense WHERE interpolated AND NOT detected),
stretches AS (SELECT video_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS length FROM st0 GROUP BY video_id, k)"""


@query("w8_interpolated_stretches", "dense", sql=f"WITH {STRETCH_SQL} SELECT * FROM stretches")
def _(dense):
    return iv.interpolated_stretches(dense, chunk=CHUNK)


@query("k7_top_stretches", "dense", sql=f"""
WITH {STRETCH_SQL} SELECT video_id, start_frame, length, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY length DESC, start_frame) AS rank FROM stretches) q WHERE rank <= 10""")
def _(dense):
    return iv.top_stretches(iv.interpolated_stretches(dense, chunk=CHUNK)).select("video_id", "start_frame", "length", F.col("rank").cast("long").alias("rank"))


@query("j7_detections_in_stretches", "dense", "detections", sql=f"""
WITH {STRETCH_SQL} SELECT s.video_id, s.start_frame, s.end_frame, s.length, (SELECT count(DISTINCT d.frame_id) FROM detections d WHERE d.video_id = s.video_id AND d.frame_id BETWEEN s.start_frame AND s.end_frame) AS n_detected FROM stretches s""")
def _(dense, detections):
    return iv.detections_in_stretches(iv.interpolated_stretches(dense, chunk=CHUNK), detections, dense, chunk=CHUNK)


@query("w7_longest_detected_run", "dense", sql="""
WITH k AS (SELECT video_id, frame_id, frame_id - row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS k FROM dense WHERE detected AND NOT interpolated),
r AS (SELECT video_id, min(frame_id) AS s, count(*) AS n FROM k GROUP BY video_id, k), b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, s) AS rn FROM r)
SELECT video_id, s AS start_frame, n AS length, s + n // 2 AS seed_frame FROM b WHERE rn = 1""")
def _(dense):
    return iv.longest_detected_run(dense, chunk=CHUNK)


EPI_SQL = GT_SQL + """,
err AS (SELECT g.video_id, g.frame_id, d.detected, sqrt(((x1 + x2) / 2.0::DOUBLE - center_x)^2 + ((y1 + y2) / 2.0::DOUBLE - center_y)^2) AS error FROM gt_dense g JOIN dense d ON g.video_id = d.video_id AND g.frame_id = d.frame_id),
big AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER (PARTITION BY video_id ORDER BY frame_id) < 20 THEN 0 ELSE 1 END AS brk FROM err WHERE error > 60),
epi AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY frame_id)::BIGINT AS episode FROM big)"""


def dense_errors(dense, frames, gt):
    truth = ev.interpolate_keyframes(frames, gt, chunk=CHUNK)
    return ev.centre_errors(centred(dense), truth).join(dense.select("video_id", "frame_id", "detected"), ["video_id", "frame_id"])


@query("w9_error_episodes", "dense", "frames", "gt_centers", sql=f"""
WITH {EPI_SQL} SELECT video_id, episode, min(frame_id) AS start_frame, max(frame_id) AS end_frame, max(frame_id) - min(frame_id) + 1 AS span, count(*) AS n_errors, round(avg(error), 6) + 0.0 AS mean_error,
  count(*) FILTER (detected) AS n_detected FROM epi GROUP BY video_id, episode""")
def _(dense, frames, gt):
    return rounded(iv.episode_summary(iv.error_episodes(dense_errors(dense, frames, gt), limit=60.0, chunk=CHUNK)), "mean_error")


@query("k7_episode_heads", "dense", "frames", "gt_centers", sql=f"""
WITH {EPI_SQL} SELECT video_id, episode, frame_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, episode ORDER BY frame_id) AS rank FROM epi) q WHERE rank <= 5""")
def _(dense, frames, gt):
    heads = iv.episode_heads(iv.error_episodes(dense_errors(dense, frames, gt), limit=60.0, chunk=CHUNK))
    return heads.select("video_id", "episode", "frame_id", F.col("rank").cast("long").alias("rank"))


@query("a33_crowded_error_frames", "dense", "frames", "gt_centers", "detections", sql=f"""
WITH {EPI_SQL} SELECT b.video_id, count(*) AS n_errors, count(*) FILTER (c > 1) AS n_crowded FROM big b
LEFT JOIN (SELECT video_id, frame_id, count(*) AS c FROM detections GROUP BY ALL) d ON b.video_id = d.video_id AND b.frame_id = d.frame_id GROUP BY b.video_id""")
def _(dense, frames, gt, detections):
    return iv.crowded_error_frames(dense_errors(dense, frames, gt), detections, limit=60.0)


@query("a32_zone_counts", "dense", sql="""
SELECT video_id, count(*) AS n, count(*) FILTER (detected) AS n_detected, count(*) FILTER (interpolated) AS n_interpolated FROM dense WHERE frame_id BETWEEN 100 AND 400 GROUP BY video_id""")
def _(dense):
    return iv.zone_counts(dense, 100, 400)


HOTA_SQL = GT_SQL + """,
com AS (SELECT t.video_id, t.frame_id, cx, cy, center_x, center_y, sqrt((cx - center_x)^2 + (cy - center_y)^2) AS error FROM track t JOIN gt_dense g ON t.video_id = g.video_id AND t.frame_id = g.frame_id),
prv AS (SELECT *, lag(error) OVER w AS pe, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy, center_x - lag(center_x) OVER w AS gx, center_y - lag(center_y) OVER w AS gy FROM com WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)),
agr AS (SELECT *, CASE WHEN dx^2 + dy^2 > 0 AND gx^2 + gy^2 > 0 THEN ((dx * gx + dy * gy) / (sqrt(dx^2 + dy^2) * sqrt(gx^2 + gy^2)) + 1) / 2 ELSE 1 END AS agree FROM prv),
thr AS (SELECT video_id, t.threshold, count(*) AS n, count(*) FILTER (error <= t.threshold) AS hits, coalesce(sum(agree) FILTER (pe IS NOT NULL AND error <= t.threshold AND pe <= t.threshold), 0) AS s
  FROM agr CROSS JOIN (SELECT unnest(range(10, 101, 10)) AS threshold) t GROUP BY video_id, t.threshold),
per AS (SELECT video_id, threshold, n, hits::DOUBLE / n AS det_a, CASE WHEN n = 1 THEN 1 WHEN hits < 2 THEN 0 ELSE s / (n - 1) END AS ass_a FROM thr)"""


@query("w24_direction_consistency", "track", "frames", "gt_centers", sql=f"""
WITH {HOTA_SQL} SELECT video_id, frame_id, round(agree, 6) + 0.0 AS agreement FROM agr WHERE pe IS NOT NULL""")
def _(track, frames, gt):
    rows = ht.matched_pairs(track, ev.interpolate_keyframes(frames, gt, chunk=CHUNK), chunk=CHUNK).where("agreement IS NOT NULL")
    return rounded(rows, "agreement").select("video_id", "frame_id", "agreement")


@query("a11_hota_by_threshold", "track", "frames", "gt_centers", sql=f"""
WITH {HOTA_SQL} SELECT video_id, threshold::DOUBLE AS threshold, n AS n_frames, round(det_a, 6) + 0.0 AS det_a, round(ass_a, 6) + 0.0 AS ass_a, round(sqrt(det_a * ass_a), 6) + 0.0 AS hota FROM per""")
def _(track, frames, gt):
    out = ht.hota_by_threshold(track, ev.interpolate_keyframes(frames, gt, chunk=CHUNK), chunk=CHUNK)
    return rounded(out, "det_a", "ass_a", "hota")


@query("a11_hota", "track", "frames", "gt_centers", sql=f"""
WITH {HOTA_SQL} SELECT video_id, any_value(n) AS n_frames, round(avg(sqrt(det_a * ass_a)), 6) + 0.0 AS hota, round(avg(det_a), 6) + 0.0 AS det_a, round(avg(ass_a), 6) + 0.0 AS ass_a FROM per GROUP BY video_id""")
def hota_report(track, frames, gt):
    return rounded(ht.hota(track, ev.interpolate_keyframes(frames, gt, chunk=CHUNK), chunk=CHUNK), "hota", "det_a", "ass_a")
