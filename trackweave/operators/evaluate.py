"""Agreement of tracks and detections with annotated centres."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.geometry import distance
from trackweave.operators.quantiles import exact_quantiles
from trackweave.operators.series import CHUNK_FRAMES, FRAME, VIDEO, running
from trackweave.session import materialize

CENTRE = ("center_x", "center_y")


def bracket(
    frames: DataFrame, keyframes: DataFrame, values: Sequence[str], *, keys: Sequence[str] = VIDEO,
    order: str = FRAME, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """As-of join on both sides: each frame gets `_a` and `_b`, the keyframes at or around it.

    Keyframes without a frame row take part as anchors but give no output row.
    """
    keys = list(keys)
    anchor = F.struct(F.col(order).alias(order), *[F.col(v) for v in values])
    side = keyframes.select(*keys, order, anchor.alias("_k"))
    spine = frames.select(*keys, order, F.lit(True).alias("_f"))
    merged = spine.join(side, [*keys, order], "full")
    around = running(
        merged, keys=keys, order=order, lasts={"_a": F.col("_k")}, firsts={"_b": F.col("_k")}, chunk=chunk
    )
    return around.where("_f").select(*keys, order, "_a", "_b")


def lerp(value: str, order: str = FRAME) -> Column:
    """Linear interpolation between the `_a` and `_b` anchors of `bracket`."""
    a, b = F.col("_a"), F.col("_b")
    t = (F.col(order) - a[order]) / (b[order] - a[order])
    return F.when(a[order] == b[order], a[value]).otherwise(a[value] + t * (b[value] - a[value]))


def interpolate_keyframes(
    frames: DataFrame, keyframes: DataFrame, values: Sequence[str] = CENTRE, *, keys: Sequence[str] = VIDEO,
    order: str = FRAME, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Sparse keyframes on the dense frames they span; frames outside the span are dropped.

    A series with a single keyframe keeps that keyframe, whether or not it has a frame row.
    """
    keys = list(keys)
    around = bracket(frames, keyframes, values, keys=keys, order=order, chunk=chunk)
    inside = around.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(
        *keys, order, *[lerp(v, order).alias(v) for v in values]
    )
    single = keyframes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias(order), *[F.min(v).alias(v) for v in values]
    ).where("_n = 1").drop("_n")
    missing = single.join(frames.select(*keys, order), [*keys, order], "left_anti")
    return inside.unionByName(missing)


def interpolate_with_lead(
    frames: DataFrame, keyframes: DataFrame, values: Sequence[str] = CENTRE, *, keys: Sequence[str] = VIDEO,
    order: str = FRAME, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """As `interpolate_keyframes`, but frames before the first keyframe copy it; none after the last."""
    around = bracket(frames, keyframes, values, keys=keys, order=order, chunk=chunk).where("_b IS NOT NULL")
    return around.select(
        *keys, order,
        *[F.when(F.col("_a").isNull(), F.col("_b")[v]).otherwise(lerp(v, order)).alias(v) for v in values],
    )


def centre_errors(
    track: DataFrame, truth: DataFrame, *, keys: Sequence[str] = VIDEO, order: str = FRAME,
    pred: tuple[str, str] = ("cx", "cy"), gt: tuple[str, str] = CENTRE,
) -> DataFrame:
    """One row per annotated frame; `error` is null where the track has no row."""
    left = truth.select(*keys, order, *gt)
    right = track.select(*keys, order, *pred)
    return left.join(right, [*keys, order], "left").withColumn("error", distance(*pred, *gt))


def distribution(
    df: DataFrame, value: str, keys: Sequence[str] = VIDEO, *, probs: Mapping[str, float],
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Moments and exact quantiles of a column per group; groups with only nulls keep null quantiles."""
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), *[c.alias(k) for k, c in (extra or {}).items()],
    )
    return stats.join(exact_quantiles(df, keys, value, probs), list(keys), "left")


def distance_summary(df: DataFrame, value: str, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Count, mean, p50, p90, p95, max; everything but the count is null for an empty group."""
    out = distribution(df, value, keys, probs={"p50": 0.5, "p90": 0.9, "p95": 0.95})
    return out.select(*keys, F.col("n").alias("count"), "mean", "p50", "p90", "p95", "max")


def track_error_report(
    track: DataFrame, truth: DataFrame, *, threshold: float = 50.0, keys: Sequence[str] = VIDEO,
) -> DataFrame:
    """Per video: error statistics, share within the threshold and detection rate, in percent."""
    errors = materialize(centre_errors(track, truth, keys=keys).select(*keys, "error"))
    out = distribution(
        errors, "error", keys, probs={"median": 0.5, "p90": 0.9, "p95": 0.95},
        extra={
            "n_truth": F.count(F.lit(1)),
            "n_missed": F.count_if(F.col("error").isNull()),
            "n_within": F.count_if(F.col("error") <= F.lit(threshold)),
        },
    )
    return out.select(
        *keys, F.col("n").alias("n_evaluated"), "n_missed", F.col("mean").alias("mean_error"),
        F.col("median").alias("median_error"), F.col("std").alias("std_error"), F.col("max").alias("max_error"),
        F.col("p90").alias("p90_error"), F.col("p95").alias("p95_error"),
        F.when(F.col("n") > 0, F.col("n_within") / F.col("n") * 100).alias("pct_within"),
        (F.col("n") / F.col("n_truth") * 100).alias("detection_rate"),
    )
