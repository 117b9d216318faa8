"""Folds: behaviour on a moving object, equality with plain loops, and independence of the cuts."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave.functions.motion import velocity_consistency
from trackweave.operators import sequential as sq
from trackweave.operators.gapfill import fill_linear

W, H = 640, 480


def moving(step, n=100, shift=None):
    rows = []
    for f in range(0, n, step):
        cx, cy = 200 + f // 4, 240
        if shift and f == shift:
            cx += 500
        rows.append((0, f, f, 1, cx - 30, cy - 30, cx + 30, cy + 30, 0.95))
    return pd.DataFrame(rows, columns=["video_id", "frame_id", "det_no", "track_id", "x1", "y1", "x2", "y2", "confidence"])


def videos(spark, n=100, count=1):
    return spark.createDataFrame([(v, n, W, H) for v in range(count)], "video_id long, n_frames long, img_w long, img_h long")


def spine(spark, n=100):
    return spark.range(n).select(F.lit(0).cast("long").alias("video_id"), F.col("id").alias("frame_id"), F.lit(W).cast("long").alias("img_w"), F.lit(H).cast("long").alias("img_h"))


def trace_of(spark, n=100, speed=0.25):
    return spark.createDataFrame([(0, f, 200 + f * speed, 240.0) for f in range(n)], "video_id long, frame_id long, trace_x double, trace_y double")


def test_guard_accepts_motion_and_rejects_the_jump(spark):
    obs = spark.createDataFrame(moving(5, shift=50))
    for trace in (None, trace_of(spark)):
        out = sq.guard_identity(obs, trace, max_jump=150.0, piece=16).toPandas()
        assert out[~out.accepted].frame_id.tolist() == [50]
        assert len(out) == 20
    fast = spark.createDataFrame(moving(5).assign(x1=lambda d: d.x1 + d.frame_id * 7 // 4, x2=lambda d: d.x2 + d.frame_id * 7 // 4))
    assert sq.guard_identity(fast, trace_of(spark, speed=2.0), max_jump=150.0).toPandas().accepted.all()


def test_guard_with_trace_equals_one_pass(spark):
    r = np.random.default_rng(5)
    n = 300
    obs = moving(1, n)
    obs[["x1", "x2"]] = obs[["x1", "x2"]].add(r.choice([0, 0, 90, 160, 400], n), axis=0)
    t = trace_of(spark, n).where("frame_id % 11 <> 0")
    cut, whole = (sq.guard_identity(spark.createDataFrame(obs), t, max_jump=100.0, piece=c).toPandas().sort_values("frame_id", ignore_index=True) for c in (8, 10_000))
    pd.testing.assert_frame_equal(cut, whole)
    last, expect = None, []
    for row in obs.itertuples():
        if row.frame_id % 11 == 0:
            expect.append(True)
            continue
        c = ((row.x1 + row.x2) / 2, (row.y1 + row.y2) / 2)
        of = math.dist(c, (200 + row.frame_id * 0.25, 240))
        ok = not (of > 100 and (last is None or math.dist(c, last) > 50))
        last = c if ok else last
        expect.append(ok)
    assert whole.accepted.tolist() == expect


def crowded(n=240, seed=2):
    """Stretches with one person, others with bystanders that come and go."""
    r = np.random.default_rng(seed)
    rows = []
    for f in range(n):
        k = 1 if (f // 12) % 2 == 0 else int(r.integers(1, 4))
        for i in range(k):
            cx, cy = 200 + f // 2 + i * 140 + int(r.integers(0, 20)), 240 + i * 20
            rows.append((0, f, len(rows), None if r.random() < 0.1 else i, cx - 20, cy - 40, cx + 20 + i, cy + 40, float(r.uniform(0.3, 0.99))))
    return pd.DataFrame(rows, columns=["video_id", "frame_id", "det_no", "track_id", "x1", "y1", "x2", "y2", "confidence"])


@pytest.mark.parametrize("gate,size", [(False, 0.0), (True, 0.0), (False, 0.3)])
def test_resolver_is_independent_of_the_cuts(spark, gate, size):
    pdf = crowded()
    dets = spark.createDataFrame(pdf.astype({"track_id": "Int64"}))
    params = sq.ResolverParams(gate=gate, radius=40.0, w_size=size)
    trace = trace_of(spark, 240, 0.5).where("frame_id % 5 <> 0")
    if gate:  # for a while the trace is far from everybody, so a synthetic candidate competes
        trace = trace.withColumn("trace_y", F.when(F.col("frame_id").between(97, 111), 400.0).otherwise(F.col("trace_y")))
    frames = sq.candidate_frames(dets, trace, videos(spark, 240), params)
    cut, whole = (sq.resolve_conflicts(frames, params, chunk=c, piece=c).toPandas().sort_values("frame_id", ignore_index=True) for c in (20, 100_000))
    pd.testing.assert_frame_equal(cut, whole)
    assert len(whole) == pdf.frame_id.nunique()
    assert whole.frame_id.is_unique
    if gate:
        assert whole.of_synthetic.any()


def test_single_candidates_are_taken_and_conflicts_counted(spark):
    dets = spark.createDataFrame(crowded().astype({"track_id": "Int64"}))
    out = sq.resolve_conflicts(sq.candidate_frames(dets, None, videos(spark, 240)), chunk=50)
    pdf = out.toPandas()
    assert not pdf[pdf.n_candidates == 1].conflict.any()
    assert pdf[pdf.conflict].margin.ge(0).all()
    summary = sq.conflict_summary(out).toPandas().iloc[0]
    assert summary.conflict_frames == pdf.conflict.sum() and summary.of_available == 0


@pytest.mark.parametrize("history,v,low,high", [
    ([], (1, 0), 0.5, 0.5), ([(1, 0)] * 2, (1, 0), 0.5, 0.5), ([(5, 0)] * 5, (5, 0), 0.99, 1.0), ([(5, 0)] * 5, (-5, 0), 0.3, 0.4),
    ([(5, 0)] * 5, (0, 5), 0.6, 0.75), ([(5, 0)] * 5, (0, 0), 0.0, 0.3), ([(0, 0)] * 5, (0, 0), 0.6, 0.7), ([(0, 9), (0, 9), (9, 0), (9, 0), (9, 0)], (9, 0), 0.85, 1.0)])
def test_velocity_score(spark, history, v, low, high):
    score = sq.velocity_score(history, *map(float, v))
    assert low <= score <= high
    df = spark.createDataFrame([([(float(a), float(b)) for a, b in history], float(v[0]), float(v[1]))], "h array<struct<vx:double,vy:double>>, vx double, vy double")
    assert df.select(velocity_consistency("h", "vx", "vy")).first()[0] == pytest.approx(score)


def test_trace_follows_flow_and_reanchors(spark):
    flow = spark.range(1, 100).select(F.lit(0).cast("long").alias("video_id"), F.col("id").alias("frame_id"), F.lit(0.25).alias("dx"), F.lit(0.0).alias("dy"))
    seed = spark.createDataFrame([(0, 40, 210.0, 240.0)], "video_id long, seed_frame long, seed_x double, seed_y double")
    pure = sq.flow_trace(spine(spark), flow, seed).toPandas().sort_values("frame_id")
    assert pure.frame_id.tolist() == list(range(100))
    np.testing.assert_allclose(pure.trace_x, 210 + (np.arange(100) - 40) * 0.25)
    drifting = flow.withColumn("dx", F.lit(3.0))
    obs = spark.createDataFrame(moving(1))
    anchored = sq.flow_trace(spine(spark), drifting, seed, obs).toPandas().set_index("frame_id").trace_x
    assert max(abs(anchored[f] - (200 + f // 4)) for f in range(45, 100)) < 20
    assert anchored[0] == max(0, 210 - 40 * 3)  # backwards it only follows the flow
    selected = sq.flow_trace(spine(spark), drifting, seed, obs, sq.TraceParams(mode="selected", interval=50, min_confidence=0.5, max_drift=1e9)).toPandas().set_index("frame_id").trace_x
    hits = [f for f in range(41, 100) if selected[f] == 200 + f // 4]
    assert hits[0] == 40 + 25  # confident frames count twice


def test_flow_fill_equals_a_plain_loop(spark):
    r = np.random.default_rng(9)
    n = 90
    seen = moving(1, n).iloc[[35, 36, 40, 41, 58, 59]]
    dx, dy = r.normal(size=n) * 4, r.normal(size=n) * 4
    flow = spark.createDataFrame([(0, f, float(dx[f]), float(dy[f]), float(-dx[min(f + 1, n - 1)]), float(-dy[min(f + 1, n - 1)])) for f in range(n)], "video_id long, frame_id long, dx double, dy double, back_dx double, back_dy double")
    out = sq.fill_by_flow(spark.createDataFrame(seen), videos(spark, n), flow, sq.FlowFillParams(min_gap=5, drift_guard=1e9, extrapolate=10), chunk=16).toPandas().set_index("frame_id").sort_index()
    assert out.index.tolist() == list(range(n))
    boxes = {int(s.frame_id): [int(s.x1), int(s.y1), int(s.x2), int(s.y2)] for s in seen.itertuples()}

    def step(b, x, y):
        m = [round(b[0] + x), round(b[1] + y), round(b[2] + x), round(b[3] + y)]
        m[0], m[1] = max(0, min(m[0], W - 1)), max(0, min(m[1], H - 1))
        m[2], m[3] = max(m[0] + 1, min(m[2], W)), max(m[1] + 1, min(m[3], H))
        return m

    fwd, bwd = {41: boxes[41]}, {58: boxes[58]}
    for f in range(42, 58):
        fwd[f] = step(fwd[f - 1], dx[f], dy[f])
    for f in range(57, 41, -1):
        bwd[f] = step(bwd[f + 1], -dx[f + 1], -dy[f + 1])
    for f in range(42, 58):
        t = (f - 41) / (58 - 41)
        assert out.loc[f, ["x1", "y1", "x2", "y2"]].tolist() == [round((1 - t) * a + t * b) for a, b in zip(fwd[f], bwd[f])]
    lead = boxes[35]
    for f in range(34, 24, -1):
        lead = step(lead, -dx[f + 1], -dy[f + 1])
        assert out.loc[f, ["x1", "y1", "x2", "y2"]].tolist() == lead
    assert all(out.loc[f, ["x1", "y1", "x2", "y2"]].tolist() == lead for f in range(25))
    assert out.loc[[37, 38, 39], "fill"].eq("line").all() and out.loc[0, "fill"] == "held"
    assert out.detected.sum() == 6


def test_linear_fill_covers_every_frame(spark):
    seen = moving(1, 50).iloc[[10, 11, 20, 49]].assign(of_synthetic=[False, True, False, False])
    out = fill_linear(spark.createDataFrame(seen), videos(spark, 60), chunk=7).toPandas().set_index("frame_id").sort_index()
    assert out.index.tolist() == list(range(60))
    assert out.loc[0, "x1"] == seen.x1.iloc[0] and out.loc[59, "x1"] == seen.x1.iloc[-1]
    assert out.detected.sum() == 3 and out.loc[11, "interpolated"] and out.loc[11, "of_synthetic"]


@pytest.mark.parametrize("window", [2, 5, 9])
def test_ema_equals_a_plain_loop(spark, window):
    r = np.random.default_rng(window)
    n = 700
    x = r.integers(0, 600, n).astype(float)
    pdf = pd.DataFrame({"video_id": 0, "frame_id": range(n), "x1": x})
    out = sq.smooth_ema(spark.createDataFrame(pdf), window, columns=("x1",), chunk=50, rounded=False).toPandas().sort_values("frame_id").x1.to_numpy()
    a = 2 / (window + 1)
    fwd, bwd = x.copy(), x.copy()
    for i in range(1, n):
        fwd[i] = a * x[i] + (1 - a) * fwd[i - 1]
    for i in range(n - 2, -1, -1):
        bwd[i] = a * x[i] + (1 - a) * bwd[i + 1]
    np.testing.assert_allclose(out, (fwd + bwd) / 2, rtol=1e-12)


def dense_kalman(obs, det, flow, run, p):
    n = len(obs)
    T = np.eye(8)
    T[[0, 1, 2, 3], [2, 3, 4, 5]] = 1
    T[[0, 1], [4, 5]] = 0.5
    Q = np.diag([1, 1, 4, 4, 8, 8, 0.5, 0.5]) * max(1.0, p.window)
    Hm, Hv = np.zeros((4, 8)), np.zeros((2, 8))
    Hm[0, 0] = Hm[1, 1] = Hm[2, 6] = Hm[3, 7] = Hv[0, 2] = Hv[1, 3] = 1
    P0 = np.diag([5.0, 5, 25, 25, 100, 100, 10, 10])
    first = lambda i: np.array([obs[i, 0], obs[i, 1], flow[i, 0], flow[i, 1], 0, 0, obs[i, 2], obs[i, 3]])
    xs, Ps, xp, Pp, cut = [first(0)], [P0], [first(0)], [P0], set()
    for i in range(1, n):
        x, P = T @ xs[-1], T @ Ps[-1] @ T.T + Q
        x[4:6] = np.clip(x[4:6], -40, 40)
        xp.append(x.copy())
        Pp.append(P.copy())
        if p.reinit_gap > 0 and det[i] and run[i] >= p.reinit_gap:
            x, P = first(i), P0
            cut.add(i)
        R = np.diag([p.r_detected] * 2 + [8, 8]) if det[i] else np.diag([p.r_interpolated] * 2 + [16, 16])
        K = P @ Hm.T @ np.linalg.inv(Hm @ P @ Hm.T + R)
        x, P = x + K @ (obs[i] - Hm @ x), (np.eye(8) - K @ Hm) @ P
        if abs(flow[i]).max() > 0.01:
            K = P @ Hv.T @ np.linalg.inv(Hv @ P @ Hv.T + 10 * np.eye(2))
            x, P = x + K @ (flow[i] - Hv @ x), (np.eye(8) - K @ Hv) @ P
        xs.append(x)
        Ps.append(P)
    s = [None] * n
    s[-1] = xs[-1]
    for i in range(n - 2, -1, -1):
        s[i] = xs[i] if i + 1 in cut else xs[i] + Ps[i] @ T.T @ np.linalg.inv(Pp[i + 1]) @ (s[i + 1] - xp[i + 1])
    return np.array(s)


@pytest.mark.parametrize("reinit", [0, 3])
def test_kalman_equals_the_matrix_form_and_ignores_cuts(spark, reinit):
    r = np.random.default_rng(reinit)
    n = 900
    obs = np.cumsum(r.normal(size=(n, 4)) * [4, 4, 0.3, 0.3], 0) + [500, 500, 60, 120]
    det = r.random(n) > 0.3
    flow = r.normal(size=(n, 2)) * (r.random((n, 1)) > 0.5) * 3
    run = np.zeros(n, int)
    k = 0
    for i in range(1, n):
        run[i], k = k, 0 if det[i] else k + 1
    p = sq.KalmanParams(reinit_gap=reinit)
    np.testing.assert_allclose(sq.kalman_rts(obs, det, flow, run, p), dense_kalman(obs, det, flow, run, p), atol=1e-8)
    box = np.rint(np.column_stack([obs[:, 0] - obs[:, 2] / 2, obs[:, 1] - obs[:, 3] / 2, obs[:, 0] + obs[:, 2] / 2, obs[:, 1] + obs[:, 3] / 2])).astype(int)
    pdf = pd.DataFrame(box, columns=["x1", "y1", "x2", "y2"]).assign(video_id=0, frame_id=range(n), detected=det, flow_vx=flow[:, 0], flow_vy=flow[:, 1])
    df = spark.createDataFrame(pdf)
    cut, whole = (sq.smooth_kalman(df, p, piece=c).toPandas().sort_values("frame_id", ignore_index=True) for c in (40, 10_000))
    pd.testing.assert_frame_equal(cut, whole)


def test_point_filter_predicts_missing(spark):
    rows = [(0, f, None if f in (0, 5, 6) else 10.0 + f, None if f in (0, 5, 6) else 50.0) for f in range(20)]
    out = sq.smooth_points(spark.createDataFrame(rows, "video_id long, frame_id long, venue_x double, venue_y double")).toPandas().sort_values("frame_id")
    assert len(out) == 20 and out.notna().all().all()
    assert abs(out.venue_x.iloc[-1] - 29) < 0.5 and abs(out.venue_y - 50).max() < 1e-9


def test_kalman_of_a_long_clipped_video_is_the_uncut_one(spark):
    r = np.random.default_rng(4)
    n = 9300
    at = np.cumsum(np.cumsum(np.where(np.arange(n) // 400 % 2, 90.0, -90.0)))  # beyond the clip of the acceleration
    box = np.rint(np.column_stack([at, at / 2, at + 60, at / 2 + 90]) + r.normal(size=(n, 1)) * 5).astype(int)
    det = np.arange(n) < 7000
    pdf = pd.DataFrame(box, columns=["x1", "y1", "x2", "y2"]).assign(video_id=0, frame_id=range(n), detected=det, flow_vx=0.0, flow_vy=0.0)
    lone = pdf.iloc[:1].assign(video_id=1, x2=pdf.x1[0] + 3)
    got = sq.smooth_kalman(spark.createDataFrame(pd.concat([pdf, lone])), piece=450).toPandas().sort_values(["video_id", "frame_id"], ignore_index=True)
    b = box.astype(float)
    obs = np.column_stack([(b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2, b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]])
    want = sq.kalman_rts(obs, det, np.zeros((n, 2)), np.zeros(n, int), sq.KalmanParams())
    np.testing.assert_array_equal(got[["vx", "vy"]].to_numpy()[:n], want[:, 2:4])
    assert len(got) == n + 1 and got.iloc[n][["x1", "x2"]].tolist() == lone[["x1", "x2"]].iloc[0].tolist()
