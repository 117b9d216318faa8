"""Summaries over videos, rank correlation and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.geometry import percent_gain
from trackweave.operators.quantiles import value_bin
from trackweave.operators.series import VIDEO, running
from trackweave.session import materialize

BINS_PER_CHUNK = 16


def macro_summary(report: DataFrame, value: str, name: str = "video_id") -> DataFrame:
    """Mean, best and worst of a per-video figure with the videos' names; the smaller name on ties."""
    present = report.where(F.col(value).isNotNull())
    low = F.min(F.struct(F.col(value).alias("v"), F.col(name).alias("n")))
    high = F.max(F.struct(F.col(value).alias("v"), (-F.col(name)).alias("n")))
    out = present.agg(F.count(F.lit(1)).alias("n_videos"), F.avg(value).alias("mean"), low.alias("_lo"), high.alias("_hi"))
    return out.select(
        "n_videos", "mean", F.col("_lo.v").alias("min"), F.col("_lo.n").alias("min_video"), F.col("_hi.v").alias("max"), (-F.col("_hi.n")).alias("max_video"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """1-based rank of each distinct value, ties sharing the mean of their places.

    Values are counted first and ranked inside fixed value bins, so one large group is not sorted whole.
    """
    keys = list(keys)
    counted = materialize(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w")).withColumn("_bin", value_bin(F.col(value))))
    upto = running(counted, keys=keys, order=("_bin", value), sums={"_to": F.col("_w")}, chunk=BINS_PER_CHUNK)
    rank = F.col("_to") - F.col("_w") + (F.col("_w") + 1) / F.lit(2.0)
    return upto.select(*keys, value, rank.alias(name))


def score_metrics(predictions: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Spearman correlation with average ties, relative and absolute error per group."""
    keys = list(keys)
    ranked = predictions.join(average_ranks(predictions, keys, "score_true", "_rt"), [*keys, "score_true"]).join(
        average_ranks(predictions, keys, "score_pred", "_rp"), [*keys, "score_pred"])
    miss = F.abs(F.col("score_pred") - F.col("score_true"))
    return ranked.groupBy(*keys).agg(
        F.corr("_rt", "_rp").alias("spearman_rho"), F.avg(miss / (F.abs(F.col("score_true")) + 1e-8)).alias("relative_l2"),
        F.avg(miss).alias("mae"), F.count(F.lit(1)).alias("n"))


def prediction_table(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("abs_error", F.abs(F.col("score_pred") - F.col("score_true")))


def compare_models(predictions: DataFrame, baseline: str, other: str) -> DataFrame:
    """Metrics of both models on the stems the other one scored."""
    mine = predictions.where(F.col("model") == other)
    base = predictions.where(F.col("model") == baseline).join(mine.select("stem"), "stem", "left_semi")
    return score_metrics(base.unionByName(mine))


def minmax_scaled(rows: DataFrame, value: str, low: str, high: str) -> DataFrame:
    span = F.col(high) - F.col(low) + 1e-8
    scaled = (F.col(value) - F.col(low)) / span
    return rows.withColumn("scaled", scaled).withColumn("restored", F.col("scaled") * span + F.col(low))


def combined_report(detection: DataFrame, tracking: DataFrame, hota: DataFrame) -> DataFrame:
    """Detection and tracking figures side by side; a video needs only one of them.  Best HOTA first."""
    d = detection.select(
        *VIDEO, F.col("mean_error").alias("det_error"), F.col("detection_rate").alias("det_rate"), F.col("pct_within").alias("det_within"),
        F.col("correct_person_rate").alias("det_correct"), F.col("unique_tracks").alias("det_ids"), F.col("longest_run_ratio").alias("det_longest_run"))
    t = tracking.select(*VIDEO, F.col("mean_error").alias("trk_error"), F.col("pct_within").alias("trk_within")).join(
        hota.select(*VIDEO, F.col("hota").alias("trk_hota")), list(VIDEO), "left")
    both = d.join(t, list(VIDEO), "full").withColumn("improvement", percent_gain("det_error", "trk_error"))
    return both.orderBy(F.coalesce("trk_hota", F.lit(0.0)).desc())


def averages(report: DataFrame, columns: Sequence[str]) -> DataFrame:
    return report.agg(*[F.avg(c).alias(c) for c in columns])


def ms_per_frame(results: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    ok = (F.col("elapsed_s") > 0) & ~F.isnan("elapsed_s")
    seconds, frames = F.sum(F.when(ok, F.col("elapsed_s"))), F.sum(F.when(ok, F.col("n_frames")))
    return results.groupBy(*keys).agg(
        seconds.alias("total_s"), frames.alias("total_frames"), F.when(frames > 0, seconds * 1000 / frames).otherwise(0.0).alias("ms_per_frame"))


def stage_times(results: DataFrame, stages: Sequence[str], *, row: str = "video_id") -> DataFrame:
    """Stages as columns per row, skipped (-1) and failed (NaN) runs left out of every sum."""
    ok = (F.col("elapsed_s") > 0) & ~F.isnan("elapsed_s")
    usable = results.withColumn("elapsed_s", F.when(ok, F.col("elapsed_s")))
    wide = usable.groupBy(row).pivot("stage", list(stages)).agg(F.sum("elapsed_s"))
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages), F.lit(0.0))
    return wide.select(row, *[F.col(s).alias(f"stage_{s}") for s in stages], total.alias("total"))


def stage_averages(results: DataFrame) -> DataFrame:
    ok = (F.col("elapsed_s") > 0) & ~F.isnan("elapsed_s")
    return results.groupBy("stage").agg(F.coalesce(F.avg(F.when(ok, F.col("elapsed_s"))), F.lit(0.0)).alias("average_s"))


def deltas(report: DataFrame, baseline: DataFrame, columns: Sequence[str], keys: Sequence[str] = VIDEO) -> DataFrame:
    """Report plus `<column>_delta` against the baseline row of the same keys."""
    base = baseline.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    joined = report.join(base, list(keys), "left")
    return joined.select(*report.columns, *[(F.col(c) - F.col(f"_b_{c}")).alias(f"{c}_delta") for c in columns])
