"""Prefix composition and hand-over against plain loops on long and crowded videos."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave.operators import sequential as sq
from trackweave.operators import series as se

W, H = 640, 480


def videos(spark, n, count=1):
    return spark.createDataFrame([(v, n, W, H) for v in range(count)], "video_id long, n_frames long, img_w long, img_h long")


def spine(spark, n):
    return spark.range(n).select(F.lit(0).cast("long").alias("video_id"), F.col("id").alias("frame_id"), F.lit(W).cast("long").alias("img_w"), F.lit(H).cast("long").alias("img_h"))


def crowd(n, seed, people=(2, 5), spread=300.0):
    """Never fewer than two people a frame, some of them jumping about."""
    r = np.random.default_rng(seed)
    k = r.integers(people[0], people[1], n)
    frame = np.repeat(np.arange(n), k)
    cx = 320 + 200 * np.sin(frame / 60) + r.uniform(-spread, spread, len(frame)) * (r.random(len(frame)) < 0.5)
    cy = 240 + 100 * np.cos(frame / 45) + r.uniform(-40, 40, len(frame))
    x1, y1 = np.rint(cx - 20).astype(int), np.rint(cy - 40).astype(int)
    return pd.DataFrame({"video_id": 0, "frame_id": frame, "det_no": np.arange(len(frame)), "track_id": r.integers(0, 6, len(frame)), "x1": x1, "y1": y1, "x2": x1 + 40 + r.integers(0, 9, len(frame)), "y2": y1 + 80, "confidence": r.uniform(0.3, 0.99, len(frame)).round(3)})


@pytest.mark.parametrize("chunk", [1, 7, 64, 5000])
def test_clamped_shifts_compose(spark, chunk):
    r = np.random.default_rng(chunk)
    rows, want = [], {}
    for video, n in ((0, 400), (1, 1), (2, 65)):
        x, y = 30.0, 20.0
        for i in range(n):
            dx, dy = (float(v) for v in r.integers(-160, 161, 2) / 4)
            x, y = (x, y) if i == 0 else (max(0.0, min(x + dx, W - 1)), max(0.0, min(y + dy, H - 1)))
            rows.append((video, i, 1, i, dx, dy, W, H, 30.0, 20.0))
            want[video, i] = (x, y)
    df = spark.createDataFrame(rows, "video_id long, frame_id long, side int, step long, dx double, dy double, img_w long, img_h long, seed_x double, seed_y double").repartition(5)
    got = {(r.video_id, r.frame_id): (r.trace_x, r.trace_y) for r in sq.carried_trace(df, chunk=chunk).collect()}
    assert got == want


def test_point_filter_equals_a_plain_loop(spark):
    r = np.random.default_rng(3)
    n = 2500
    z = np.cumsum(r.normal(size=(n, 2)), 0) * 3 + 100
    gone = r.random(n) < 0.3
    gone[:4] = gone[700:1100] = True
    pdf = pd.DataFrame({"video_id": 0, "frame_id": np.arange(n) * 2 + 5, "venue_x": np.where(gone, np.nan, z[:, 0]), "venue_y": np.where(gone, np.nan, z[:, 1])})
    df = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("venue_x", "venue_y")})
    got = sq.smooth_points(df, chunk=32).toPandas().sort_values("frame_id")[["venue_x", "venue_y"]].to_numpy()
    move = np.eye(4)
    move[0, 2] = move[1, 3] = 1
    first = np.flatnonzero(~gone)[0]
    s, cov, want = np.array([*z[first], 0, 0]), np.eye(4) * 100.0, []
    for i in range(n):
        s, cov = move @ s, move @ cov @ move.T + np.eye(4)
        if not gone[i]:
            gain = np.linalg.solve(cov[:2, :2] + np.eye(2) * 5, cov[:2]).T
            s, cov = s + gain @ (z[i] - s[:2]), cov - gain @ cov[:2]
        want.append(s[:2])
    np.testing.assert_allclose(got, want, rtol=1e-8)


def test_a_state_that_is_never_forgotten_is_still_handed_over(spark):
    n = 200
    df = spark.range(n).select((F.col("id") % 2).alias("video_id"), F.col("id").alias("frame_id"), (F.col("id") * 7 % 13).cast("double").alias("v"))

    def fold(state, rows):
        out = []
        for v in rows["v"].tolist():
            state["sum"] = state.get("sum", 0.0) + v
            out.append(state["sum"])
        return rows[["video_id", "frame_id"]].assign(total=out)

    got = se.handed_over(df, fold, "video_id long, frame_id long, total double", piece=20, run_in=4).toPandas().sort_values("frame_id")
    pdf = df.toPandas().sort_values("frame_id")
    assert got.total.tolist() == pdf.groupby("video_id").v.cumsum().tolist()


def test_pieces_run_again_only_where_the_state_differs(spark):
    """A fold with a short memory settles in one round but for the piece whose run-in lies in a quiet stretch."""
    n = 400
    df = spark.range(n).select(F.lit(0).cast("long").alias("video_id"), F.col("id").alias("frame_id"), F.when((F.col("id") < 90) | (F.col("id") > 130), F.col("id")).cast("double").alias("v"))
    ran = spark.sparkContext.accumulator(0)

    def fold(state, rows):
        out = []
        for v in rows["v"].tolist():
            if not math.isnan(v):
                state["last"] = v
            out.append(state.get("last", -1.0))
        if len(rows) == 50:
            ran.add(1)
        return rows[["video_id", "frame_id"]].assign(last=out)

    got = se.handed_over(df, fold, "video_id long, frame_id long, last double", piece=50, run_in=5).toPandas().sort_values("frame_id")["last"].tolist()
    assert got == [float(i if i < 90 or i > 130 else 89) for i in range(n)]
    assert ran.value == 8 + 1  # the piece from 100 on


def plain_trace(people, flow, n, seed):
    """The re-anchored trace of default parameters, frame by frame."""
    frame, x, y, drift, since = seed[0], seed[1], seed[2], 0.0, 0
    out = {frame: (x, y)}
    for t in range(frame + 1, n):
        dx, dy = flow[t]
        x, y = max(0.0, min(x + dx, W - 1)), max(0.0, min(y + dy, H - 1))
        drift, since = drift + math.hypot(dx, dy), since + 1
        best, near = math.inf, None
        for cx, cy in people.get(t, ()):
            if (d := math.hypot(cx - x, cy - y)) < best:
                best, near = d, (cx, cy)
        if best < 150 and (since >= 5 or drift > 150):
            x, y, drift, since = *near, 0.0, 0
        out[t] = (x, y)
    return out


def test_anchored_trace_of_a_crowded_long_video(spark):
    n = 100_000
    pdf = crowd(n, 6, spread=500.0)
    pdf = pdf[(pdf.frame_id % 3 > 0) & ((pdf.frame_id < 40_000) | (pdf.frame_id > 43_000))]
    r = np.random.default_rng(1)
    flow = r.integers(-24, 25, (n, 2)) / 4
    flow_df = spark.createDataFrame(pd.DataFrame({"video_id": 0, "frame_id": np.arange(n), "dx": flow[:, 0], "dy": flow[:, 1]}))
    seed = spark.createDataFrame([(0, 7, 300.0, 200.0)], "video_id long, seed_frame long, seed_x double, seed_y double")
    trace = sq.flow_trace(spine(spark, n), flow_df, seed, spark.createDataFrame(pdf))
    got = trace.toPandas().set_index("frame_id").sort_index()
    people = {}
    for f, a, b, c, d in pdf[["frame_id", "x1", "x2", "y1", "y2"]].itertuples(index=False):
        people.setdefault(f, []).append(((a + b) / 2, (c + d) / 2))
    want = plain_trace(people, flow, n, (7, 300.0, 200.0))
    assert len(got) == n
    np.testing.assert_array_equal(got.loc[7:, ["trace_x", "trace_y"]].to_numpy(), [want[t] for t in range(7, n)])
    assert n / se.PIECE_FRAMES > 20  # tasks, none with more than a twentieth of the video


def test_resolver_of_a_crowd_without_a_sure_frame(spark):
    n = 3000
    dets = spark.createDataFrame(crowd(n, 8))
    frames = sq.candidate_frames(dets, None, videos(spark, n))
    cut, whole = (sq.resolve_conflicts(frames, piece=p).toPandas().sort_values("frame_id", ignore_index=True) for p in (128, 10_000))
    pd.testing.assert_frame_equal(cut, whole)
    assert len(whole) == n and whole.conflict.any()


def test_sure_frames_equal_a_pass_over_all(spark):
    """Frames that stay in the JVM come out as from a fold over every frame."""
    pdf = crowd(600, 9, people=(1, 3))
    pdf = pdf[(pdf.frame_id % 100 > 40) | ~pdf.duplicated("frame_id")]
    frames = sq.candidate_frames(spark.createDataFrame(pdf), None, videos(spark, 600))
    got = sq.resolve_conflicts(frames).toPandas().sort_values("frame_id", ignore_index=True)
    rows = frames.toPandas().sort_values("frame_id", ignore_index=True)
    rows["pos"], rows["variant"] = np.arange(len(rows)), 0
    want = sq._resolver_fold([sq.ResolverParams()])({}, rows.astype({"trace_x": float, "trace_y": float}))
    for c in ("x1", "y1", "x2", "y2", "confidence", "track_id", "det_no", "n_candidates", "conflict"):
        assert got[c].tolist() == want[c].tolist(), c


def test_guard_of_a_long_video(spark):
    n = 20_000
    pdf = crowd(n, 5, people=(1, 2), spread=400.0).drop_duplicates("frame_id")
    got = sq.guard_identity(spark.createDataFrame(pdf), None, max_jump=120.0, piece=500).toPandas().sort_values("frame_id")
    last, want = None, []
    for a, b, c, d in pdf.sort_values("frame_id")[["x1", "x2", "y1", "y2"]].itertuples(index=False):
        p = ((a + b) / 2, (c + d) / 2)
        ok = last is None or math.dist(p, last) <= 120
        last = p if ok else last
        want.append(ok)
    assert got.accepted.tolist() == want and not all(want)


def test_pieces_share_groups_and_may_end_in_another_batch(spark, monkeypatch):
    """Many short pieces are folded in few groups, and a piece that is cut by an Arrow batch is folded whole."""
    n = 300
    df = spark.range(n).select((F.col("id") % 3).alias("video_id"), F.floor(F.col("id") / 3).alias("frame_id"), (F.col("id") * 7 % 13).cast("double").alias("v"))
    plans, kept = [], se.materialize

    def seen(made):
        plans.append(made._jdf.queryExecution().optimizedPlan().toString())
        return kept(made)

    def fold(state, rows):
        out = []
        for v in rows["v"].tolist():
            state["sum"] = state.get("sum", 0.0) + v
            out.append(state["sum"])
        return rows[["video_id", "frame_id"]].assign(total=out)

    monkeypatch.setattr(se, "materialize", seen)
    monkeypatch.setattr(se, "BUCKETS_PER_PARTITION", 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = se.handed_over(df, fold, "video_id long, frame_id long, total double", piece=25, run_in=4).toPandas().sort_values(["video_id", "frame_id"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    pdf = df.toPandas().sort_values(["video_id", "frame_id"])
    assert got.total.tolist() == pdf.groupby("video_id").v.cumsum().tolist()
    folds = [line for plan in plans for line in plan.splitlines() if "FlatMapGroupsInPandas" in line]
    assert folds and all("[_bucket#" in line for line in folds)
