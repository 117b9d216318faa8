"""Venue, pose, learning and interval behaviour against brute force."""

import numpy as np
import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackweave.functions import pose as px
from trackweave.functions.skeleton import COCO_17, H36M_17
from trackweave.operators import intervals as iv
from trackweave.operators import learn as ln
from trackweave.operators import pose as ps
from trackweave.operators import venue as vn


def slopes(x, y):
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        return np.array([d[0], d[0]])
    for k in range(1, len(x) - 1):
        if d[k - 1] * d[k] > 0:
            w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            m[k] = (w1 + w2) / (w1 / d[k - 1] + w2 / d[k])

    def end(h0, h1, d0, d1):
        e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0.0 if np.sign(e) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(e) > 3 * abs(d0) else e

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    return m


def spline(x, y, at):
    m = slopes(x, y)
    k = int(np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2))
    h, t = x[k + 1] - x[k], (at - x[k]) / (x[k + 1] - x[k])
    return (2 * t**3 - 3 * t**2 + 1) * y[k] + (t**3 - 2 * t**2 + t) * h * m[k] + (3 * t**2 - 2 * t**3) * y[k + 1] + (t**3 - t**2) * h * m[k + 1]


@pytest.mark.parametrize("n", [3, 4, 7, 12])
def test_leave_one_out_by_flow(spark, n):
    r = np.random.default_rng(n)
    pdf = pd.DataFrame({"video_id": 0, "frame_id": range(n), "cum_dx": r.normal(size=n).cumsum(), "cum_dy": r.permutation(np.cumsum(r.uniform(0.5, 3, n))),
                        "venue_x": r.uniform(100, 900, n), "venue_y": r.uniform(100, 900, n)})
    out = vn.loo_by_flow(spark.createDataFrame(pdf), limits=(1000, 1000), chunk=4.0).toPandas().sort_values("frame_id").error.to_numpy()
    for i in range(n):
        rest, held = pdf.drop(i).sort_values("cum_dy"), pdf.loc[i]
        if len(rest) >= 3:
            pred = [spline(rest.cum_dy.to_numpy(), rest[c].to_numpy(), held.cum_dy) for c in ("venue_x", "venue_y")]
        else:
            pred = [np.polyval(np.polyfit(rest[a], rest[c], 1), held[a]) for a, c in (("cum_dx", "venue_x"), ("cum_dy", "venue_y"))]
        pred = np.clip(pred, 0, 999)
        assert out[i] == pytest.approx(np.hypot(pred[0] - held.venue_x, pred[1] - held.venue_y), rel=1e-6)


def test_votes_match_all_pairs(spark):
    r = np.random.default_rng(0)
    parts = [pd.DataFrame({"video_id": v, "frame_id": np.arange(n) * 3, "athlete_vy": r.integers(0, 40, n).astype(float), "score": 0.5}) for v, n in ((0, 133), (1, 1), (2, 2))]
    pdf = pd.concat(parts, ignore_index=True)
    out = vn.consistency_votes(spark.createDataFrame(pdf), chunk=16).toPandas()
    for v, part in pdf.groupby("video_id"):
        f, y = part.frame_id.to_numpy(), part.athlete_vy.to_numpy()
        agree = ((f[:, None] < f) & (y[:, None] <= y)) | ((f[:, None] > f) & (y[:, None] >= y))
        got = out[out.video_id == v].sort_values("frame_id").votes.tolist()
        assert got == agree.sum(1).tolist()


@pytest.mark.parametrize("anchor_score,sky_score,kept", [(0.9, 0.8, {0, 90}), (0.01, 0.8, {0, 90}), (0.9, 0.0, {0, 90}), (0.01, 0.0, {90})])
def test_forced_places(spark, anchor_score, sky_score, kept):
    rows = [(0, 0, anchor_score, True, False), (0, 90, sky_score, False, True)] + [(0, 100 + i, 0.1 + i / 100, False, False) for i in range(25)]
    out = vn.top_with_forced(spark.createDataFrame(rows, "video_id long, frame_id long, score double, is_anchor boolean, is_sky boolean"), 20).toPandas()
    assert len(out) == 20
    assert set(out.frame_id) & {0, 90} == kept


def test_ridge_leave_one_out_matches_refits(spark):
    r = np.random.default_rng(4)
    frames = []
    for g, n in (("a", 12), ("b", 7)):
        x = r.normal(size=(n, 4)) * [1, 10, 0.1, 0] + [0, 5, 100, 2]  # the last feature is constant
        frames.append(pd.DataFrame({"g": g, "stem": range(n), "x": list(map(list, x)), "y": x[:, 0] * 3 - x[:, 1] + r.normal(size=n)}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf)
    out = ln.ridge_leave_one_out(df, ["g"], "stem", "x", "y", alpha=1.0).toPandas().set_index(["g", "stem"]).score_pred
    model = ln.ridge_fit(ln.product_sums(df, ["g"], "x", "y"), ["g"], 1.0)
    fitted = ln.ridge_predict(df, model, ["g"], "x").toPandas().set_index(["g", "stem"]).score_pred

    def refit(x, y, at):
        m, s = x.mean(0), x.std(0)
        s = np.where(s < 1e-9, 1, s)
        z = (x - m) / s
        w = np.linalg.solve(z.T @ z + np.eye(x.shape[1]), z.T @ (y - y.mean()))
        return (at - m) / s @ w + y.mean()

    for g, part in pdf.groupby("g"):
        x, y = np.array(part.x.tolist()), part.y.to_numpy()
        for i in range(len(part)):
            keep = np.arange(len(part)) != i
            assert out[g, i] == pytest.approx(refit(x[keep], y[keep], x[i]), rel=1e-8)
            assert fitted[g, i] == pytest.approx(refit(x, y, x[i]), rel=1e-8)


def test_greedy_matching_is_global_best_first(spark):
    r = np.random.default_rng(7)
    def side(n):
        s = r.integers(0, 600, n)
        return pd.DataFrame({"video_id": 0, "jump_id": range(n), "start_frame": s, "end_frame": s + r.integers(1, 40, n)})
    g, p = side(60), side(70)
    pairs = iv.interval_pairs(spark.createDataFrame(g), spark.createDataFrame(p), min_iou=0.1, tolerance=1, bucket=32)
    got = {(m.gt_id, m.pred_id) for m in iv.greedy_matches(pairs, chunk=64).collect()}
    cand = []
    for a in g.itertuples():
        for b in p.itertuples():
            inter = max(0, min(a.end_frame + 1, b.end_frame) - max(a.start_frame - 1, b.start_frame) + 1)
            iou = inter / (max(a.end_frame + 1, b.end_frame) - min(a.start_frame - 1, b.start_frame) + 1)
            if iou >= 0.1:
                cand.append((iou, a.jump_id, b.jump_id))
    assert pairs.count() == len(cand)
    gs, ps_, want = set(), set(), set()
    for _, a, b in sorted(cand, reverse=True):
        if a not in gs and b not in ps_:
            gs.add(a)
            ps_.add(b)
            want.add((a, b))
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_jump_intervals_match_a_scan(spark, seed):
    r = np.random.default_rng(seed)
    vy = np.cumsum(r.normal(size=300)) % 9 - 4.5
    df = spark.createDataFrame(pd.DataFrame({"video_id": 0, "frame_id": range(300), "comp_dx": 1.0, "comp_dy": vy}))
    got = [(j.start_frame, j.end_frame, j.peak_frame) for j in iv.jump_intervals(df, min_airtime=3, chunk=32).orderBy("start_frame").collect()]
    want, i = [], 0
    while i < 300:
        if vy[i] < -3:
            j = i + 1
            while j < 300 and vy[j] < 3:
                j += 1
            if j - i >= 3:
                want.append((i, j - 1, i + int(np.argmin(vy[i:j]))))
            i = j
        else:
            i += 1
    assert got == want
    with pytest.raises(ValueError):
        iv.jump_intervals(df, threshold=0)


def pose_row(spark, conf=0.9):
    kp = [(100.0 + j, 200.0, conf if j > 4 else 0.0) for j in range(17)]
    return spark.createDataFrame([(0, 0, kp)], "video_id long, frame_id long, kp array<struct<x:double,y:double,conf:double>>")


def test_h36m_conversion(spark):
    names = lambda ref: F.array(*[F.lit(n) for n in ref])
    row = pose_row(spark)
    out = row.select(px.to_h36m("kp", names([n.upper() for n in COCO_17])).alias("h")).first().h
    at = dict(zip(H36M_17, out))
    assert at["pelvis"].x == 111.5 and at["thorax"].x == 105.5 and at["spine"].x == 108.5
    assert at["head"] == at["thorax"] == at["neck"]  # no confident face point
    assert at["left_wrist"].x == 109 and at["right_ankle"].x == 116
    with pytest.raises((PySparkException, Py4JJavaError)):
        row.select(px.to_h36m("kp", names(["a"] * 17)).alias("h")).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        row.select(px.hip_index(names(["nose", "left_hip"]), "right").alias("i")).collect()


def test_skeleton_adjacency(spark):
    got = {(r.part, r.i, r.j): r.w for r in ps.skeleton_adjacency(spark).collect()}
    a = np.zeros((3, 17, 17))
    a[0] = np.eye(17)
    for p, c in px.H36M_BONES:
        a[1, p, c] = a[2, c, p] = 1
    for k in range(3):
        d = a[k].sum(1)
        inv = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1e-12)), 0)
        n = inv[:, None] * a[k] * inv
        for i, j in zip(*a[k].nonzero()):
            assert got[k, i, j] == pytest.approx(n[i, j])
    assert len(got) == 17 + 16 + 16


def test_augmentation_is_repeatable_and_small(spark):
    df = spark.range(40).select((F.col("id") % 4).alias("video_id"), F.col("id").alias("frame_id"), F.array(*[F.struct(F.lit(float(j)).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z")) for j in range(17)]).alias("pose"))
    a, b = (ps.augmented(x, noise=0.01, seed=3).orderBy("frame_id").collect() for x in (df, df.repartition(7)))
    assert a == b
    z = np.array([[p.z for p in r.pose] for r in a]) - 2.0
    assert 0.005 < z.std() < 0.015 and abs(z.mean()) < 0.003


def test_fixed_length_samples(spark):
    df = spark.createDataFrame([(v, f) for v, n in ((0, 50), (1, 5), (2, 8)) for f in range(0, n * 2, 2)], "video_id long, frame_id long")
    out = ps.fixed_length(df, 8, seed=1, chunk=4).toPandas().sort_values(["video_id", "slot"])
    assert out.groupby("video_id").slot.apply(list).map(lambda s: s == list(range(8))).all()
    crop = out[out.video_id == 0].frame_id.to_numpy()
    assert (np.diff(crop) == 2).all() and 0 <= crop[0] <= 84
    assert out[out.video_id == 1].frame_id.tolist() == [0, 2, 4, 6, 8, 8, 8, 8]
