"""Higher-order tracking accuracy of a single object over distance thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.geometry import distance
from trackweave.operators.series import CHUNK_FRAMES, FRAME, VIDEO, running

THRESHOLDS = tuple(float(t) for t in range(10, 101, 10))


def matched_pairs(track: DataFrame, truth: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Shared frames with their error, the worse error of the step from the previous shared frame,
    and that step's direction agreement in [0, 1] (1 when either side stands still)."""
    common = track.select(*VIDEO, FRAME, "cx", "cy").join(truth.select(*VIDEO, FRAME, "center_x", "center_y"), [*VIDEO, FRAME])
    common = common.withColumn("error", distance("cx", "cy", "center_x", "center_y"))
    here = F.struct("cx", "cy", "center_x", "center_y", "error")
    p = running(common, prevs={"_p": here}, chunk=chunk)
    px, py = F.col("cx") - F.col("_p.cx"), F.col("cy") - F.col("_p.cy")
    gx, gy = F.col("center_x") - F.col("_p.center_x"), F.col("center_y") - F.col("_p.center_y")
    norm = F.sqrt(px * px + py * py) * F.sqrt(gx * gx + gy * gy)
    agree = F.when(norm > 0, ((px * gx + py * gy) / norm + 1) / 2).otherwise(F.lit(1.0))
    has = F.col("_p").isNotNull()
    return p.select(
        *VIDEO, FRAME, "error", F.when(has, F.greatest("error", F.col("_p.error"))).alias("pair_error"), F.when(has, agree).alias("agreement"))


def hota_by_threshold(track: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """DetA, AssA and their geometric mean per threshold; all thresholds from one aggregation."""
    rows = matched_pairs(track, truth, chunk=chunk)
    aggs = []
    for i, t in enumerate(thresholds):
        aggs.append(F.count_if(F.col("error") <= t).alias(f"h{i}"))
        aggs.append(F.coalesce(F.sum(F.when(F.col("pair_error") <= t, F.col("agreement"))), F.lit(0.0)).alias(f"s{i}"))
    wide = rows.groupBy(*VIDEO).agg(F.count(F.lit(1)).alias("n"), *aggs)
    n = F.col("n")
    per = [
        F.struct(
            F.lit(float(t)).alias("threshold"), (F.col(f"h{i}") / n).alias("det_a"),
            F.when(n == 1, 1.0).when(F.col(f"h{i}") < 2, 0.0).otherwise(F.col(f"s{i}") / (n - 1)).alias("ass_a"))
        for i, t in enumerate(thresholds)
    ]
    out = wide.select(*VIDEO, n.alias("n_frames"), F.inline(F.array(*per)))
    return out.withColumn("hota", F.sqrt(F.col("det_a") * F.col("ass_a")))


def hota(track: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS, *, videos: DataFrame | None = None, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Averages over the thresholds; videos without a shared frame score 0 when `videos` is given."""
    per = hota_by_threshold(track, truth, thresholds, chunk=chunk)
    out = per.groupBy(*VIDEO).agg(
        F.first("n_frames").alias("n_frames"), F.avg("hota").alias("hota"), F.avg("det_a").alias("det_a"), F.avg("ass_a").alias("ass_a"))
    if videos is None:
        return out
    return videos.select(*VIDEO).join(out, list(VIDEO), "left").fillna(0)
