"""Sweeps equal separate runs; leave-one-out equals refits in every shape of group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_handover import crowd, videos
from trackweave.operators import experiments as ex
from trackweave.operators import learn as ln
from trackweave.operators import sequential as sq
from trackweave.operators.gapfill import fill_linear


def test_sweep_equals_separate_runs(spark):
    n = 300
    dets = pd.concat([crowd(n, 4, people=(1, 4)), crowd(n, 5, people=(2, 4)).assign(video_id=1)])
    dets = dets[dets.frame_id % 9 > 0]
    pool, vids = spark.createDataFrame(dets), videos(spark, n, 2)
    configs = [ex.TrackingConfig(f"{c} {w}", sq.ResolverParams(w_stickiness=c, w_velocity=1 - c, w_size=s), w) for c, s in ((0.1, 0.0), (0.9, 0.3)) for w in (0, 5)]
    got = ex.tracking_runs(pool, vids, configs).toPandas()
    assert len(got) == 4 * 2 * n
    for c in configs:
        alone = fill_linear(sq.resolve_conflicts(sq.candidate_frames(pool, None, vids, c.resolver), c.resolver), vids).select("video_id", "frame_id", *sq.BOX)
        alone = (sq.smooth_ema(alone, c.window) if c.window else alone).toPandas().sort_values(["video_id", "frame_id"], ignore_index=True)
        mine = got[got.config == c.name].drop(columns="config").sort_values(["video_id", "frame_id"], ignore_index=True)
        pd.testing.assert_frame_equal(mine, alone)
    assert got.groupby("config").x1.apply(tuple).nunique() == 4
    truth = spark.createDataFrame([(v, f, 300.0, 200.0) for v in (0, 1) for f in range(0, n, 10)], "video_id long, frame_id long, center_x double, center_y double")
    report = ex.tracking_sweep(pool, vids, truth, configs, configs[0].name).toPandas()
    assert len(report) == 8 and (report[report.config == configs[0].name].mean_error_delta == 0).all()
    with pytest.raises(ValueError):
        sq.resolve_variants(sq.candidate_frames(pool, None, vids), [sq.ResolverParams(), sq.ResolverParams(radius=9.0)])


@pytest.mark.parametrize("n,p,block", [(2, 3, 4096), (3, 2, 1), (5, 8, 2), (60, 12, 7), (400, 30, 64)])
def test_leave_one_out_equals_refits(spark, n, p, block):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, p)) * r.uniform(0.1, 50, p) + r.uniform(-9, 9, p)
    x[:, 0] = 4.0 if n % 2 else x[:, 0]  # constant
    if n > 10:
        x[:, 1] = np.where(np.arange(n) == 3, 7.0, 0.0)  # constant without one record
    y = x @ r.normal(size=p) + r.normal(size=n)
    df = spark.createDataFrame([(0, i, x[i].tolist(), float(y[i])) for i in range(n)], "g long, stem long, x array<double>, y double")
    got = ln.ridge_leave_one_out(df, ["g"], "stem", "x", "y", block=block).toPandas().set_index("stem").score_pred
    assert len(got) == n
    for i in range(n):
        keep = np.arange(n) != i
        scale = x[keep].std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = (x[keep] - x[keep].mean(axis=0)) / scale
        w = np.linalg.solve(z.T @ z + np.eye(p), z.T @ (y[keep] - y[keep].mean())) / scale
        assert got[i] == pytest.approx((x[i] - x[keep].mean(axis=0)) @ w + y[keep].mean(), rel=1e-6, abs=1e-6)
    alone = spark.createDataFrame([(1, 0, [1.0, 2.0], 3.0)], "g long, stem long, x array<double>, y double")
    assert ln.ridge_leave_one_out(alone, ["g"], "stem", "x", "y").toPandas().score_pred.isna().all()


def test_records_of_one_model_are_not_joined_in_one_task(spark):
    rows = [("m", i, float((i * 7919) % 503)) for i in range(600)] + [("n", 1, 2.0), ("n", 2, 1.0), ("n", 3, 5.0), ("n", 4, 4.0)]
    records = spark.createDataFrame(rows, "model string, stem long, score_true double")
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = ex.fold_ranges(ex.fold_plan(records)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    tasks = [r.task for r in out if r.model == "m"]
    assert len(tasks) == 600 and max(tasks.count(t) for t in tasks) < 400
    for model in "mn":
        own = [(score, stem) for m, stem, score in rows if m == model]
        last = sorted(own, key=lambda p: (p[0], -p[1]))[:2]
        for r in (r for r in out if r.model == model):
            val = last[0][1] if r.stem != last[0][1] else last[1][1]
            left = [p[0] for p in own if p[1] not in (r.stem, val)]
            assert (r.val_stem, r.low, r.high) == (val, min(left), max(left))
