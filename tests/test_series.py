"""Series primitives against pandas, with one video holding most rows and chunks small enough to matter."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave.operators.quantiles import exact_quantiles
from trackweave.operators.series import halo_window, islands, ordered_scan, running, with_position


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    parts = []
    for video, n in ((0, 400), (1, 60), (2, 1)):
        frames = np.sort(r.choice(1000, n, replace=False))
        v = np.where(r.random(n) < 0.5, np.nan, r.integers(0, 50, n).astype(float))
        parts.append(pd.DataFrame({"video_id": video, "frame_id": frames, "v": v}))
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("chunk", [7, 64, 10_000])
def test_running_matches_pandas(spark, rows, chunk):
    value = F.when(~F.isnan("v"), F.col("v"))
    out = running(
        spark.createDataFrame(rows), sums={"s": F.coalesce(value, F.lit(0.0))}, lasts={"a": value}, firsts={"b": value},
        prevs={"p": F.col("frame_id")}, nexts={"n": F.col("frame_id")}, prior_maxes={"m": F.col("frame_id") % 17}, chunk=chunk,
    ).toPandas().sort_values(["video_id", "frame_id"], ignore_index=True)
    g = rows.groupby("video_id")
    expect = rows.assign(
        s=rows.v.fillna(0).groupby(rows.video_id).cumsum(), a=g.v.ffill(), b=g.v.bfill(), p=g.frame_id.shift(), n=g.frame_id.shift(-1),
        m=(rows.frame_id % 17).groupby(rows.video_id).cummax().groupby(rows.video_id).shift())
    for c in "sabpnm":
        np.testing.assert_allclose(out[c].astype(float), expect[c].astype(float), err_msg=c)


def test_positions_and_islands(spark, rows):
    df = spark.createDataFrame(rows[["video_id", "frame_id"]])
    pos = with_position(df, chunk=13).toPandas().sort_values(["video_id", "frame_id"])
    assert (pos.pos.to_numpy() == pos.groupby("video_id").cumcount().to_numpy()).all()
    runs = islands(df, F.col("frame_id") % 10 == 0, chunk=13).toPandas().sort_values(["video_id", "frame_id"])
    assert (runs.island.to_numpy() == (runs.frame_id % 10 == 0).groupby(runs.video_id).cumsum().to_numpy()).all()


@pytest.mark.parametrize("chunk", [5, 50])
def test_halo_window_matches_rolling(spark, chunk):
    n = 203
    pdf = pd.DataFrame({"video_id": 0, "frame_id": range(n), "v": np.arange(n, dtype=float) ** 1.5})
    out = halo_window(
        spark.createDataFrame(pdf), lambda w: {"m": F.sum("v").over(w.rowsBetween(-3, 2)), "l": F.lag("v", 3).over(w)}, before=3, after=2, chunk=chunk,
    ).toPandas().sort_values("frame_id", ignore_index=True)
    assert len(out) == n
    expect = [pdf.v[max(0, i - 3):i + 3].sum() for i in range(n)]
    np.testing.assert_allclose(out.m, expect)
    np.testing.assert_allclose(out.l, pdf.v.shift(3))
    with pytest.raises(ValueError):
        halo_window(spark.createDataFrame(pdf), lambda w: {}, before=9, chunk=5)


def test_ordered_scan_keeps_state_across_batches(spark, rows):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        def fold(state, pdf):
            seen = state.get("n", 0) + np.arange(1, len(pdf) + 1)
            ok = bool((np.diff([state.get("f", -1), *pdf.frame_id]) > 0).all())
            state["n"], state["f"] = int(seen[-1]), int(pdf.frame_id.iloc[-1])
            return pdf[["video_id", "frame_id"]].assign(i=seen, ok=ok)

        out = ordered_scan(spark.createDataFrame(rows[["video_id", "frame_id"]].sample(frac=1, random_state=0)), fold, "video_id long, frame_id long, i long, ok boolean").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    out = out.sort_values(["video_id", "frame_id"])
    assert out.ok.all()
    assert (out.i.to_numpy() == out.groupby("video_id").cumcount().to_numpy() + 1).all()


def test_exact_quantiles_match_numpy(spark):
    r = np.random.default_rng(3)
    groups = {"a": np.concatenate([r.normal(size=3000) * 1e4, np.zeros(500)]), "b": np.array([5.0]), "c": -r.exponential(size=77) * 1e7, "d": np.array([1.0, 2.0])}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in groups.items()])
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    out = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs).toPandas().set_index("k")
    for k, v in groups.items():
        np.testing.assert_allclose(out.loc[k, list(probs)].astype(float), np.quantile(v, list(probs.values())), rtol=1e-12)
