"""Scoring, selection and diagnosis of track fragments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import centre_proximity, distance, with_box_geometry
from trackweave.operators.evaluate import distribution
from trackweave.operators.quantiles import exact_quantiles
from trackweave.operators.series import CHUNK_FRAMES, FRAME, VIDEO, islands, running, with_position
from trackweave.session import materialize

TRACK = "track_id"
SCORE_BIN = 0.01  # ranks are computed inside score bins, so no video is sorted in one task


@dataclass(frozen=True)
class SelectionParams:
    min_frames: int = 10
    w_conf: float = 0.3
    w_center: float = 0.5
    w_length: float = 0.2
    threshold: float = 0.4
    adaptive: bool = False
    threshold_low: float = 0.35
    threshold_high: float = 0.45
    min_overlap_ratio: float = 0.5
    min_confidence: float = 0.0
    boundary_zone: float = 0.05


def tracked(detections: DataFrame) -> DataFrame:
    return with_box_geometry(detections.where(F.col(TRACK).isNotNull()))


def track_scores(detections: DataFrame, videos: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """Score of every fragment, whatever its length; `long_enough` marks those that compete."""
    sized = tracked(detections).join(videos, "video_id")
    grouped = sized.groupBy("video_id", TRACK).agg(
        F.avg("confidence").alias("mean_conf"),
        F.avg(centre_proximity("cx", "cy", "img_w", "img_h")).alias("mean_center"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(FRAME, "det_no")).alias("first_seen"),
        F.first("n_frames").alias("n_frames"),
    )
    score = (
        F.lit(params.w_conf) * F.col("mean_conf") + F.lit(params.w_center) * F.col("mean_center")
        + F.lit(params.w_length) * F.col("n") / F.col("n_frames")
    )
    return grouped.withColumn("score", score).withColumn("long_enough", F.col("n") >= params.min_frames)


def competing_tracks(scored: DataFrame) -> DataFrame:
    """Fragments that are long enough; in a video without any, the longest one with score 0."""
    best = scored.groupBy("video_id").agg(
        F.max("long_enough").alias("any_long"),
        F.max_by(TRACK, F.struct("n", -F.col("first_seen.frame_id"), -F.col("first_seen.det_no"))).alias("longest"),
    )
    joined = scored.join(best, "video_id")
    fallback = ~F.col("any_long") & (F.col(TRACK) == F.col("longest"))
    return (
        joined.where(F.col("long_enough") | fallback)
        .withColumn("score", F.when(fallback, 0.0).otherwise(F.col("score")))
        .withColumn("length_fallback", fallback)
        .drop("any_long", "longest")
    )


def choose_threshold(competing: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """Per video: the low threshold when too few detections clear the high one."""
    clears = F.col("score") >= F.lit(params.threshold_high)
    rate = F.coalesce(F.sum(F.when(clears, F.col("n"))), F.lit(0)) / F.greatest(F.max("n_frames"), F.lit(1))
    low = F.col("high_rate") < F.lit(params.min_overlap_ratio)
    return competing.groupBy("video_id").agg(rate.alias("high_rate")).withColumn(
        "threshold",
        F.when(low, params.threshold_low).otherwise(params.threshold_high) if params.adaptive else F.lit(params.threshold),
    )


def select_tracks(competing: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """All competing tracks with `selected`: over the threshold, else the single best one.

    They are written once: thresholds, best tracks and the selection itself read them, and each would score all detections anew.
    """
    competing = materialize(competing)
    return over_threshold(competing.join(choose_threshold(competing, params), "video_id"))


def over_threshold(scored: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Selection by a `threshold` column, constant per key group."""
    best = scored.groupBy(*keys).agg(
        F.max(F.struct("score", -F.col("first_seen.frame_id"), -F.col("first_seen.det_no"), TRACK)).alias("b")
    ).select(*keys, F.col("b.score").alias("top_score"), F.col(f"b.{TRACK}").alias("top_track"))
    over = F.col("score") >= F.col("threshold")
    used_fallback = F.col("top_score") < F.col("threshold")
    return scored.join(best, list(keys)).withColumns({
        "over": over,
        "used_fallback": used_fallback,
        "selected": over | (used_fallback & (F.col(TRACK) == F.col("top_track"))),
    }).drop("top_score", "top_track")


def rank_tracks(scored: DataFrame) -> DataFrame:
    """1-based rank by score, first appearance first on ties."""
    keyed = scored.withColumns({
        "_neg": -F.col("score"), "_f": F.col("first_seen.frame_id"), "_d": F.col("first_seen.det_no")})
    ranked = with_position(keyed, "rank", order=("_neg", "_f", "_d"), chunk=SCORE_BIN)
    return ranked.withColumn("rank", F.col("rank") + 1).drop("_neg", "_f", "_d")


def candidates(detections: DataFrame, selection: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Detections of the selected tracks that are confident enough to be merged."""
    chosen = selection.where("selected").select("video_id", TRACK)
    return tracked(detections).where(F.col("confidence") >= min_confidence).join(chosen, ["video_id", TRACK], "left_semi")


def pool_diagnostics(pool: DataFrame, selection: DataFrame) -> DataFrame:
    """Per video: how many candidates compete per frame and how many tracks were taken."""
    per_frame = pool.groupBy("video_id", FRAME).agg(
        F.count(F.lit(1)).alias("c"), F.sum("confidence").alias("s"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi")
    )
    frames = per_frame.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frames_with_detections"), F.sum("c").alias("total_candidates"),
        F.avg("c").alias("avg_candidates"), F.count_if(F.col("c") > 1).alias("multi_frames"),
        F.avg((F.col("c") > 1).cast("double")).alias("multi_ratio"),
        (F.sum("s") / F.sum("c")).alias("confidence_mean"), F.min("lo").alias("confidence_min"), F.max("hi").alias("confidence_max"),
    )
    taken = selection.groupBy("video_id").agg(
        F.first("threshold").alias("threshold_used"), F.first("used_fallback").alias("threshold_fallback"),
        F.count_if("selected").alias("merged_tracks"),
        F.count_if(~F.col("over") & ~F.col("used_fallback")).alias("excluded_tracks"),
    )
    return taken.join(frames, "video_id", "left")


def track_status(selection: DataFrame, zone: float = 0.05) -> DataFrame:
    """Long form of the included / excluded / near-threshold lists."""
    return selection.select(
        "video_id", TRACK, "score", "n",
        F.when(F.col("selected"), "included").when(F.col("used_fallback"), "unlisted").otherwise("excluded").alias("status"),
        F.when(F.abs(F.col("score") - F.col("threshold")) <= F.lit(zone), F.when(F.col("over"), "included").otherwise("excluded")).alias("near_side"),
    )


def selection_audit(scored: DataFrame, *, top_n: int, threshold: float) -> DataFrame:
    """Every track ranked, flagged when it is in the top n and over the threshold."""
    return rank_tracks(scored).withColumn(
        "selected", (F.col("rank") <= top_n) & (F.col("score") >= F.lit(threshold)))


def pick_person(detections: DataFrame, strategy: str = "largest") -> DataFrame:
    """One detection per frame; the first listed wins ties, unknown names mean `largest`."""
    d = with_box_geometry(detections)
    key = {
        "center": lambda: -distance("cx", "cy", F.col("img_w") / 2, F.col("img_h") / 2),
        "highest_conf": lambda: F.col("confidence"),
    }.get(strategy, lambda: F.col("area"))()
    rest = [c for c in detections.columns if c not in ("video_id", FRAME, "det_no")]
    best = d.groupBy("video_id", FRAME).agg(
        F.max(F.struct(key.alias("key"), (-F.col("det_no")).alias("order"), *rest)).alias("b"))
    return best.select("video_id", FRAME, (-F.col("b.order")).alias("det_no"), *[F.col(f"b.{c}").alias(c) for c in rest])


def nearest_candidate(
    targets: DataFrame, detections: DataFrame, at: tuple[str, str], *, min_confidence: float | None = None,
    single_only: bool = False,
) -> DataFrame:
    """Nearest detection of the same frame for each target row; first listed wins ties."""
    d = with_box_geometry(detections)
    if single_only:
        alone = d.groupBy("video_id", FRAME).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
        d = d.join(alone, ["video_id", FRAME], "left_semi")
    if min_confidence is not None:
        d = d.where(F.col("confidence") >= min_confidence)
    pairs = targets.select("video_id", FRAME, *at).join(d, ["video_id", FRAME])
    best = pairs.groupBy("video_id", FRAME, *at).agg(
        F.min(F.struct(distance("cx", "cy", *at).alias("dist"), "det_no", TRACK, "confidence")).alias("b"))
    return best.select("video_id", FRAME, *at, "b.dist", "b.det_no", f"b.{TRACK}", "b.confidence")


def longest_same_track(picks: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Longest run of one track id over the ordered rows; a null id is a run of its own."""
    stepped = running(materialize(picks.select("video_id", FRAME, TRACK)), prevs={"_prev": F.col(TRACK)}, chunk=chunk)
    breaks = F.col(TRACK).isNull() | F.col("_prev").isNull() | (F.col(TRACK) != F.col("_prev"))
    runs = islands(stepped, breaks, "_run", chunk=chunk).groupBy("video_id", "_run").agg(
        F.count(F.lit(1)).alias("len"), F.count(TRACK).alias("ids"))
    return runs.groupBy("video_id").agg(F.max("len").alias("longest_run"), F.sum("ids").alias("_ids")).select(
        "video_id", "longest_run", (F.col("longest_run") / F.greatest("_ids", F.lit(1))).alias("longest_run_ratio"))


def detection_report(
    detections: DataFrame, selected: DataFrame, truth: DataFrame, *, threshold: float = 50.0, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Raw detections against interpolated truth: error, coverage and fragmentation per video.

    `selected` is the detection chosen per frame (video, frame, track_id).  Without any evaluated
    frame the error statistics are those of a single zero.
    """
    near = nearest_candidate(truth, detections, ("center_x", "center_y")).select("video_id", FRAME, "dist", TRACK)
    counts = detections.groupBy("video_id", FRAME).agg(F.count(F.lit(1)).alias("persons"))
    chosen = selected.select("video_id", FRAME, F.col(TRACK).alias("chosen_id"))
    rows = (
        truth.select("video_id", FRAME).join(near, ["video_id", FRAME], "left")
        .join(counts, ["video_id", FRAME], "left").join(chosen, ["video_id", FRAME], "left")
    )
    rows = materialize(rows)
    multi = F.col("persons") > 1
    stats = distribution(
        rows, "dist", probs={"median": 0.5, "p90": 0.9, "p95": 0.95},
        extra={
            "n_truth": F.count(F.lit(1)),
            "n_within": F.count_if(F.col("dist") <= threshold),
            "unique_tracks": F.countDistinct(TRACK),
            "multi_person_frames": F.count_if(multi),
            "correct": F.count_if(multi & F.col("chosen_id").eqNullSafe(F.col(TRACK))),
        },
    ).join(longest_same_track(rows, chunk=chunk), "video_id", "left")
    zero = F.lit(0.0)
    return stats.select(
        "video_id", F.col("n_truth").alias("n_evaluated"), (F.col("n_truth") - F.col("n")).alias("n_no_detection"),
        (F.col("n") / F.greatest("n_truth", F.lit(1)) * 100).alias("detection_rate"),
        *[F.coalesce(c, zero).alias(f"{c}_error") for c in ("mean", "median", "std", "max", "p90", "p95")],
        (F.col("n_within") / F.greatest("n", F.lit(1)) * 100).alias("pct_within"),
        "unique_tracks", "multi_person_frames",
        (F.col("correct") / F.greatest("multi_person_frames", F.lit(1)) * 100).alias("correct_person_rate"),
        "longest_run", "longest_run_ratio",
    )


def truth_track_ids(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """The distinct ids the annotated person gets, in long form."""
    return nearest_candidate(truth, detections, ("center_x", "center_y")).where(
        F.col(TRACK).isNotNull()).select("video_id", TRACK).distinct()


def track_coverage(detections: DataFrame, videos: DataFrame) -> DataFrame:
    spans = detections.where(F.col(TRACK).isNotNull()).groupBy("video_id", TRACK).agg(
        F.count(F.lit(1)).alias("n"), F.min(FRAME).alias("first_frame"), F.max(FRAME).alias("last_frame"))
    return spans.join(videos, "video_id").select(
        "video_id", TRACK, "n", "first_frame", "last_frame", (F.col("n") / F.col("n_frames") * 100).alias("pct_of_video"))


def min_length_impact(coverage: DataFrame, limits: Sequence[int] = (5, 10, 15, 20, 25, 30, 50)) -> DataFrame:
    """Tracks and detections lost under each minimum length, all limits from one pass."""
    aggs = []
    for m in limits:
        lost = F.col("n") < m
        aggs += [F.count_if(lost).alias(f"t{m}"), F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias(f"d{m}")]
    wide = coverage.groupBy("video_id").agg(F.count(F.lit(1)).alias("_t"), F.sum("n").alias("_d"), *aggs)
    rows = F.array(*[
        F.struct(F.lit(m).cast("long").alias("min_length"), F.col(f"t{m}").alias("ignored"), (F.col("_t") - F.col(f"t{m}")).alias("kept"),
                 F.col(f"d{m}").alias("lost_detections"), (F.col(f"d{m}") / F.col("_d") * 100).alias("pct_lost"))
        for m in limits])
    return wide.select("video_id", F.inline(rows))


def short_tracks(coverage: DataFrame, limit: int = 10) -> DataFrame:
    return coverage.where(F.col("n") < limit)


def longest_tracks(coverage: DataFrame, n: int = 20) -> DataFrame:
    """Top n tracks of each video by length; the ranking limit is applied before the shuffle."""
    w = Window.partitionBy("video_id").orderBy(F.col("n").desc(), TRACK)
    return coverage.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fragmentation(detections: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Span and largest step beyond one frame of each track."""
    seen = detections.where(F.col(TRACK).isNotNull()).groupBy("video_id", TRACK, FRAME).agg(F.count(F.lit(1)).alias("c"))
    stepped = running(seen, keys=("video_id", TRACK), prevs={"_p": F.col(FRAME)}, chunk=chunk)
    step = F.col(FRAME) - F.col("_p")
    return stepped.groupBy("video_id", TRACK).agg(
        F.sum("c").alias("n"), (F.max(FRAME) - F.min(FRAME) + 1).alias("span"),
        F.coalesce(F.max(F.when(step > 1, step)), F.lit(0)).alias("max_gap"),
        F.count_if(step > 1).alias("n_gaps"))


def person_count_histogram(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames with no, one and several persons."""
    counts = detections.groupBy("video_id", FRAME).agg(F.count(F.lit(1)).alias("c"))
    c = F.coalesce("c", F.lit(0))
    return frames.select("video_id", FRAME).join(counts, ["video_id", FRAME], "left").groupBy("video_id").agg(
        F.count_if(c == 0).alias("none"), F.count_if(c == 1).alias("one"), F.count_if(c >= 2).alias("several"))


def confidence_profile(detections: DataFrame, limits: Sequence[float] = (0.4, 0.3, 0.25, 0.2, 0.15, 0.1)) -> DataFrame:
    """Index percentiles of confidence (the sorted values at n//10, n//2, 9n//10, not interpolated)
    and the detections below 0.5 that each lower limit would let in."""
    extra = {f"extra_{round(t * 100)}": F.count_if((F.col("confidence") < 0.5) & (F.col("confidence") >= t)) for t in limits}
    stats = detections.groupBy("video_id").agg(
        F.count("confidence").alias("n"), F.min("confidence").alias("min"), F.max("confidence").alias("max"),
        *[c.alias(k) for k, c in extra.items()])
    index = {"p10": lambda n: F.floor(n / 10), "p50": lambda n: F.floor(n / 2), "p90": lambda n: F.floor(n * 9 / 10)}
    return stats.join(exact_quantiles(detections, VIDEO, "confidence", index), "video_id", "left")


def truth_proximity(detections: DataFrame, truth: DataFrame, *, near: float = 50.0) -> DataFrame:
    """Distance of every track to the truth on shared frames, closest first."""
    d = tracked(detections).join(truth, ["video_id", FRAME]).withColumn("_d", distance("cx", "cy", "center_x", "center_y"))
    stats = d.groupBy("video_id", TRACK).agg(
        F.avg("_d").alias("avg_dist"), (F.avg((F.col("_d") < near).cast("double")) * 100).alias("pct_near"),
        F.count(F.lit(1)).alias("overlap"))
    stats = stats.join(exact_quantiles(d, ("video_id", TRACK), "_d", {"median_dist": 0.5}), ["video_id", TRACK])
    ranked = with_position(stats, "rank", order=("avg_dist", TRACK), chunk=16)
    return ranked.withColumn("rank", F.col("rank") + 1)


def swing_tracks(selection_a: DataFrame, selection_b: DataFrame) -> DataFrame:
    """Tracks taken under the first configuration and not under the second."""
    key = ["video_id", TRACK]
    return selection_a.where("selected").select(*key).join(selection_b.where("selected").select(*key), key, "left_anti")
