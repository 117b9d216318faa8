"""Queries: score metrics, model comparison, sweeps, timing tables and combined reports."""

from pyspark.sql import functions as F

from trackweave.functions import pose as px
from trackweave.functions.geometry import r6, settled
from trackweave.operators import experiments as ex
from trackweave.operators import learn as ln
from trackweave.operators import metrics as me
from trackweave.operators import evaluate as ev
from trackweave.operators.sequential import ResolverParams
from trackweave.queries.accuracy import CHUNK, ERR_SQL, GT_SQL, track_report
from trackweave.queries.intervals import HOTA_SQL, hota_report
from trackweave.queries.motion import rounded
from trackweave.queries.registry import query
from trackweave.queries.tracks import NEAR_SQL, SCORED_SQL, detection_report


@query("a9_macro_summary", "track", "frames", "gt_centers", sql=f"""
WITH {ERR_SQL}, m AS (SELECT video_id, round(avg(error), 6) + 0.0 AS v FROM errors GROUP BY video_id)
SELECT count(*) AS n_videos, round(avg(v), 5) + 0.0 AS mean, min(v) AS min, arg_min(video_id, struct_pack(v := v, i := video_id)) AS min_video, max(v) AS max, arg_max(video_id, struct_pack(v := v, i := -video_id)) AS max_video FROM m WHERE v IS NOT NULL""")
def _(track, frames, gt):
    out = me.macro_summary(track_report(track, frames, gt), "mean_error")
    return out.withColumn("mean", settled("mean", 5))


METRIC_SQL = """rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY score_true) + (count(*) OVER (PARTITION BY model, score_true) - 1) / 2.0::DOUBLE AS rt,
   rank() OVER (PARTITION BY model ORDER BY score_pred) + (count(*) OVER (PARTITION BY model, score_pred) - 1) / 2.0::DOUBLE AS rp FROM {src}),
met AS (SELECT model, round(corr(rt, rp), 6) + 0.0 AS spearman_rho, round(avg(abs(score_pred - score_true) / (abs(score_true) + 1e-8)), 6) + 0.0 AS relative_l2, round(avg(abs(score_pred - score_true)), 4) + 0.0 AS mae, count(*) AS n FROM rk GROUP BY model)"""


def _metrics(df):
    return rounded(df, "spearman_rho", "relative_l2").withColumn("mae", settled("mae", 4))


@query("a20_score_metrics", "scores", sql=f"WITH {METRIC_SQL.format(src='scores')} SELECT * FROM met")
def _(scores):
    return _metrics(me.score_metrics(scores))


@query("a36_prediction_table", "scores", sql="SELECT model, stem, score_true, score_pred, round(abs(score_pred - score_true), 6) + 0.0 AS abs_error FROM scores")
def _(scores):
    return rounded(me.prediction_table(scores), "abs_error")


BOTH_SQL = """both_models AS (SELECT 'base' AS model, stem, score_true, score_pred FROM scores UNION ALL SELECT 'other', stem, score_true, score_pred + stem % 7 FROM scores WHERE score_pred > 60000),
cmp AS (SELECT * FROM both_models WHERE model = 'other' OR stem IN (SELECT stem FROM both_models WHERE model = 'other'))"""


@query("m4_j9_model_comparison", "scores", sql=f"WITH {BOTH_SQL}, {METRIC_SQL.format(src='cmp')} SELECT * FROM met")
def _(scores):
    base = scores.withColumn("model", F.lit("base"))
    other = scores.where("score_pred > 60000").withColumns({"model": F.lit("other"), "score_pred": F.col("score_pred") + F.col("stem") % 7})
    return _metrics(me.compare_models(base.unionByName(other), "base", "other"))


FOLD_SQL = """ord AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score_true DESC, stem) - 1 AS fold_idx, row_number() OVER (PARTITION BY model ORDER BY score_true, stem DESC) AS up, count(*) OVER (PARTITION BY model) AS n FROM scores),
ends AS (SELECT model, max(stem) FILTER (up = 1) AS l1, max(stem) FILTER (up = 2) AS l2 FROM ord GROUP BY model),
plan AS (SELECT o.model, fold_idx, stem, score_true, CASE WHEN stem = l1 THEN l2 ELSE l1 END AS val_stem, n - 2 AS n_train FROM ord o JOIN ends e ON o.model = e.model)"""


@query("m3_j19_fold_plan", "scores", sql=f"WITH {FOLD_SQL} SELECT * FROM plan")
def _(scores):
    return ex.fold_plan(scores)


@query("a31_fold_minmax_scaling", "scores", sql=f"""
WITH {FOLD_SQL}, lo AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score_true, stem) AS r FROM scores), hi AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score_true DESC, stem) AS r FROM scores),
m AS (SELECT p.*, (SELECT min(score_true) FROM lo WHERE lo.model = p.model AND r <= 3 AND lo.stem <> p.stem AND lo.stem <> p.val_stem) AS low, (SELECT max(score_true) FROM hi WHERE hi.model = p.model AND r <= 3 AND hi.stem <> p.stem AND hi.stem <> p.val_stem) AS high FROM plan p)
SELECT model, stem, low, high, round((score_true - low) / (high - low + 1e-8), 6) + 0.0 AS scaled, round((score_true - low) / (high - low + 1e-8) * (high - low + 1e-8) + low, 4) + 0.0 AS restored FROM m""")
def _(scores):
    out = me.minmax_scaled(ex.fold_ranges(ex.fold_plan(scores)), "score_true", "low", "high")
    return out.select("model", "stem", "low", "high", r6(F.col("scaled")).alias("scaled"), (settled("restored", 4)).alias("restored"))


@query("a29_ms_per_frame", "run_results", sql="""
SELECT config, round(sum(elapsed_s) FILTER (elapsed_s > 0), 6) + 0.0 AS total_s, sum(n_frames) FILTER (elapsed_s > 0)::BIGINT AS total_frames, round(sum(elapsed_s) FILTER (elapsed_s > 0) * 1000 / sum(n_frames) FILTER (elapsed_s > 0), 6) + 0.0 AS ms_per_frame FROM run_results GROUP BY config""")
def _(results):
    return rounded(me.ms_per_frame(results), "total_s", "ms_per_frame")


@query("a29_stage_table", "run_results", sql="""
SELECT video_id, round(sum(elapsed_s) FILTER (stage = 'F' AND elapsed_s > 0), 6) + 0.0 AS "stage_F", round(sum(elapsed_s) FILTER (stage = 'O' AND elapsed_s > 0), 6) + 0.0 AS "stage_O", round(coalesce(sum(elapsed_s) FILTER (elapsed_s > 0), 0), 6) + 0.0 AS total FROM run_results GROUP BY video_id""")
def _(results):
    return rounded(me.stage_times(results, ("F", "O")), "stage_F", "stage_O", "total")


@query("a29_stage_averages", "run_results", sql="SELECT stage, round(coalesce(avg(elapsed_s) FILTER (elapsed_s > 0), 0), 6) + 0.0 AS average_s FROM run_results GROUP BY stage")
def _(results):
    return rounded(me.stage_averages(results), "average_s")


SWEEP = (0.45, 0.5, 0.52)
SWEEP_SQL = GT_SQL + "," + SCORED_SQL + """,
cfg AS (SELECT unnest([0.45, 0.5, 0.52])::DOUBLE AS threshold),
sel AS (SELECT threshold, s.*, max(score) OVER (PARTITION BY threshold, video_id) AS top, row_number() OVER (PARTITION BY threshold, video_id ORDER BY score DESC, first_key) AS rn FROM scored s CROSS JOIN cfg WHERE n >= 10),
best AS (SELECT threshold, b.video_id, b.frame_id, cx, cy, row_number() OVER (PARTITION BY threshold, b.video_id, b.frame_id ORDER BY confidence DESC, det_no) AS k FROM boxed b JOIN sel s ON b.video_id = s.video_id AND b.track_id = s.track_id AND (score >= threshold OR (top < threshold AND rn = 1))),
er AS (SELECT c.threshold, g.video_id, sqrt((cx - center_x)^2 + (cy - center_y)^2) AS error FROM gt_dense g CROSS JOIN cfg c LEFT JOIN best b ON b.threshold = c.threshold AND b.video_id = g.video_id AND b.frame_id = g.frame_id AND k = 1),
rep AS (SELECT threshold, video_id, count(error) AS n_evaluated, avg(error) AS mean_error, count(error) * 100.0::DOUBLE / count(*) AS detection_rate FROM er GROUP BY ALL),
swp AS (SELECT r.*, r.mean_error - b.mean_error AS mean_error_delta FROM rep r LEFT JOIN rep b ON b.video_id = r.video_id AND b.threshold = 0.5)"""


@query("m8_j14_j16_threshold_sweep", "detections", "videos", "frames", "gt_centers", sql=f"""
WITH {SWEEP_SQL} SELECT threshold, video_id, n_evaluated, round(mean_error, 6) + 0.0 AS mean_error, round(detection_rate, 6) + 0.0 AS detection_rate, round(mean_error_delta, 6) + 0.0 AS mean_error_delta FROM swp""")
def sweep(detections, videos, frames, gt):
    truth = ev.interpolate_keyframes(frames, gt, chunk=CHUNK)
    return rounded(ex.selection_sweep(detections, videos, truth, SWEEP, 0.5), "mean_error", "detection_rate", "mean_error_delta")


@query("m8_sweep_means", "detections", "videos", "frames", "gt_centers", sql=f"""
WITH {SWEEP_SQL} SELECT threshold, round(avg(mean_error), 5) + 0.0 AS mean_error, round(avg(mean_error_delta), 5) + 0.0 AS mean_error_delta, count(*) AS n_videos FROM swp GROUP BY threshold""")
def _(detections, videos, frames, gt):
    truth = ev.interpolate_keyframes(frames, gt, chunk=CHUNK)
    out = ex.sweep_means(ex.selection_sweep(detections, videos, truth, SWEEP, 0.5))
    return out.withColumns({c: settled(c, 5) for c in ("mean_error", "mean_error_delta")})


@query("m8_tracking_sweep", "detections", "videos", "frames", "gt_centers")
def _(detections, videos, frames, gt):
    """Two weights of the resolver and the smoother's window, all in one job."""
    truth = ev.interpolate_keyframes(frames, gt, chunk=CHUNK)
    pool = detections.where("track_id IS NOT NULL")
    configs = [ex.TrackingConfig(f"stickiness {c} velocity {v} window {w}", ResolverParams(w_stickiness=c, w_velocity=v), w) for c in (0.0, 0.4) for v in (0.0, 0.4) for w in (0, 5)]
    return rounded(ex.tracking_sweep(pool, videos, truth, configs, configs[0].name), "mean_error", "detection_rate", "mean_error_delta")


COMBINED_SQL = HOTA_SQL + "," + NEAR_SQL[len(GT_SQL) + 1:] + """,
dr AS (SELECT video_id, round(coalesce(avg(dist), 0), 6) + 0.0 AS det_error, count(DISTINCT track_id) AS det_ids FROM eval_rows GROUP BY video_id),
tr AS (SELECT g.video_id, round(avg(sqrt((t.cx - g.center_x)^2 + (t.cy - g.center_y)^2)), 6) + 0.0 AS trk_error FROM gt_dense g LEFT JOIN track t ON g.video_id = t.video_id AND g.frame_id = t.frame_id GROUP BY g.video_id),
ho AS (SELECT video_id, round(avg(sqrt(det_a * ass_a)), 6) + 0.0 AS trk_hota FROM per GROUP BY video_id)"""


@query("m10_j10_k9_combined_report", "detections", "track", "frames", "gt_centers", sql=f"""
WITH {COMBINED_SQL}
SELECT coalesce(dr.video_id, tr.video_id) AS video_id, det_error, det_ids, trk_error, trk_hota, round((1 - trk_error / det_error) * 100, 5) + 0.0 AS improvement FROM dr FULL JOIN tr ON dr.video_id = tr.video_id LEFT JOIN ho ON ho.video_id = tr.video_id""")
def combined(d, t, frames, gt):
    out = me.combined_report(detection_report(d, t, frames, gt), track_report(t, frames, gt), hota_report(t, frames, gt))
    return out.select("video_id", "det_error", "det_ids", "trk_error", "trk_hota", (settled("improvement", 5)).alias("improvement"))


@query("p22_average_improvement", "detections", "track", "frames", "gt_centers", sql=f"""
WITH {COMBINED_SQL} SELECT round(avg(det_error), 5) + 0.0 AS det_error, round(avg(trk_error), 5) + 0.0 AS trk_error, round(avg(trk_hota), 5) + 0.0 AS trk_hota FROM dr FULL JOIN tr ON dr.video_id = tr.video_id LEFT JOIN ho ON ho.video_id = tr.video_id""")
def _(d, t, frames, gt):
    out = me.averages(combined(d, t, frames, gt), ("det_error", "trk_error", "trk_hota"))
    return out.select(*[(settled(c, 5)).alias(c) for c in out.columns])


def _records(poses):
    return poses.select("video_id", "frame_id", px.joint_angles("pose").alias("x"), px.body_height("pose").alias("y"))


@query("m1_ridge_fit_predict", "poses")
def _(poses):
    rows = _records(poses)
    model = ln.ridge_fit(ln.product_sums(rows, ["video_id"], "x", "y"), ["video_id"], alpha=1.0)
    return ln.ridge_predict(rows, model, ["video_id"], "x").select("video_id", "frame_id", "y", "score_pred")


@query("m2_leave_one_out_ridge", "poses")
def _(poses):
    return ln.ridge_leave_one_out(_records(poses), ["video_id"], "frame_id", "x", "y", alpha=1.0)
