"""Matching by locally best pairs, and equi-depth cuts, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave.operators import intervals as iv
from trackweave.operators import series as se
from trackweave.operators import venue as vn

PAIR = "video_id long, gt_id long, pred_id long, g0 long, g1 long, p0 long, p1 long, iou double"


def chain(ious):
    """gt i overlaps pred i and pred i + 1: one pile of overlaps through the whole video."""
    return [(0, k // 2, (k + 1) // 2, 10 * k, 10 * k + 15, 10 * k + 5, 10 * k + 20, float(v)) for k, v in enumerate(ious)]


def in_order(rows):
    gts, preds, out = set(), set(), set()
    for video, g, p, *_, iou in sorted(rows, key=lambda r: (r[7], r[1], r[2]), reverse=True):
        if (video, g) not in gts and (video, p) not in preds:
            gts.add((video, g))
            preds.add((video, p))
            out.add((video, g, p, iou))
    return out


@pytest.mark.parametrize("kind", ["random", "ties", "falling", "bushes"])
def test_greedy_matches_of_one_long_chain(spark, kind):
    r = np.random.default_rng(7)
    n = 3000
    if kind == "bushes":
        rows = [(int(v), int(g), int(p), 0, 9, 0, 9, float(i)) for v, g, p, i in zip(r.integers(0, 3, n), r.integers(0, 80, n), r.integers(0, 80, n), r.random(n))]
        rows = list({row[:3]: row for row in rows}.values())
    else:
        rows = chain({"random": r.random(n), "ties": r.integers(1, 4, n) / 4, "falling": np.linspace(1, 0.3, n)}[kind])
    got = {(m.video_id, m.gt_id, m.pred_id, m.iou) for m in iv.greedy_matches(spark.createDataFrame(rows, PAIR).repartition(6)).collect()}
    assert got == in_order(rows)


def test_locally_best_pairs_are_most_of_a_chain(spark):
    rows = chain(np.random.default_rng(1).random(4000))
    first = iv.locally_best(spark.createDataFrame(rows, PAIR))
    found = {(m.video_id, m.gt_id, m.pred_id, m.iou) for m in first.collect()}
    assert found <= in_order(rows) and len(found) > 1000
    assert iv.greedy_matches(spark.createDataFrame([], PAIR)).count() == 0


def test_crowded_positions_fall_into_many_chunks(spark):
    r = np.random.default_rng(2)
    n = 5000
    pdf = pd.DataFrame({"video_id": 0, "frame_id": np.arange(n), "v": r.integers(0, 900, n).astype(float)})
    pdf.loc[r.random(n) < 0.3, "v"] = 450.0  # a third in one place
    df = spark.createDataFrame(pdf)
    chunks = [c["count"] for c in se.range_chunks(df, ["video_id"], ["v", "frame_id"]).groupBy("_chunk").count().collect()]
    assert len(chunks) >= 10 and max(chunks) < n / 5
    got = se.running(df, order=("v", "frame_id"), sums={"total": F.col("v")}, prevs={"before": F.col("frame_id")}, prior_maxes={"most": F.col("frame_id")}, chunk=None)
    got = got.toPandas().sort_values(["v", "frame_id"])
    want = pdf.sort_values(["v", "frame_id"])
    assert got.total.tolist() == want.v.cumsum().tolist()
    assert got.before.tolist()[1:] == want.frame_id.tolist()[:-1]
    assert got.most.tolist()[1:] == np.maximum.accumulate(want.frame_id.to_numpy())[:-1].tolist()


def test_votes_of_crowded_positions(spark):
    r = np.random.default_rng(3)
    n = 1500
    pdf = pd.DataFrame({"video_id": 0, "frame_id": np.arange(n) * 3, "athlete_vy": r.integers(0, 900, n).astype(float), "score": 1.0})
    pdf.loc[r.random(n) < 0.3, "athlete_vy"] = 450.0
    got = vn.consistency_votes(spark.createDataFrame(pdf)).toPandas().sort_values("frame_id").votes.to_numpy()
    f, y = pdf.frame_id.to_numpy(), pdf.athlete_vy.to_numpy()
    want = ((f[None] > f[:, None]) & (y[:, None] <= y[None]) | (f[None] < f[:, None]) & (y[None] <= y[:, None])).sum(axis=1)
    assert got.tolist() == want.tolist()
