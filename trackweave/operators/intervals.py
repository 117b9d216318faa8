"""Runs, stretches, episodes and interval matching."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.motion import interval_iou
from trackweave.operators.series import CHUNK_FRAMES, FRAME, VIDEO, islands, ordered_scan, running
from trackweave.session import materialize

WORD = 64  # frames whose flags share a long
INTERVAL_BUCKET = 64  # a few times the length of an interval: longer buckets pair more, shorter ones copy more
COMPONENTS_PER_BLOCK = 1024


def jump_intervals(velocity: DataFrame, *, threshold: float = 3.0, min_airtime: int = 5, vx: str = "comp_dx", vy: str = "comp_dy", chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Airborne intervals: from the first launch (vy below -t) until vy reaches t.

    Rows at or above the threshold break the series; each stretch holds at most one jump because a
    launch row never breaks (threshold > 0).
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    t = F.lit(threshold)
    cut = islands(velocity, F.col(vy) >= t, "_seg", chunk=chunk).where(F.col(vy) < t)
    bounds = cut.groupBy(*VIDEO, "_seg").agg(
        F.min(F.when(F.col(vy) < -t, F.col(FRAME))).alias("start_frame"), F.max(FRAME).alias("end_frame"),
        F.min(F.struct(vy, FRAME, vx)).alias("low"))
    # the lowest vy of a stretch with a launch is itself a launch row, hence inside the jump
    length = F.col("end_frame") - F.col("start_frame") + 1
    return bounds.where(length >= min_airtime).select(
        *VIDEO, "start_frame", "end_frame", F.col(f"low.{FRAME}").alias("peak_frame"), length.alias("airtime_frames"),
        F.sqrt(F.col(f"low.{vx}") * F.col(f"low.{vx}") + F.col(f"low.{vy}") * F.col(f"low.{vy}")).alias("peak_speed"))


def covered_blocks(intervals: DataFrame, bits: str) -> DataFrame:
    """Per block of 64 frames that intervals touch, one bit for each frame inside an interval.

    A row per interval and block instead of one per frame, and most of them go before the shuffle.  Spark takes the blocks to be as few
    as the intervals, hence the hint: they are never broadcast.
    """
    blocks = intervals.where("start_frame <= end_frame").select(
        *VIDEO, "start_frame", "end_frame",
        F.explode(F.sequence(F.floor(F.col("start_frame") / WORD), F.floor(F.col("end_frame") / WORD))).alias("_b"))
    lo = F.greatest(F.lit(0), F.col("start_frame") - F.col("_b") * WORD).cast("int")
    hi = F.least(F.lit(WORD - 1), F.col("end_frame") - F.col("_b") * WORD).cast("int")
    ones = F.lit(-1).cast("long")
    inside = F.call_function("shiftleft", ones, lo).bitwiseAND(F.call_function("shiftrightunsigned", ones, WORD - 1 - hi))
    return blocks.groupBy(*VIDEO, "_b").agg(F.bit_or(inside).alias(bits)).hint("merge")


def flags_of_frames(frames: DataFrame, **flags: DataFrame) -> DataFrame:
    """Point-in-interval flags, each by its intervals: an equi join on blocks of frames, then the frame's bit."""
    out = frames.withColumn("_b", F.floor(F.col(FRAME) / WORD))
    at = F.pmod(F.col(FRAME), F.lit(WORD)).cast("int")
    for flag, intervals in flags.items():
        hit = F.call_function("shiftrightunsigned", F.col("_bits"), at).bitwiseAND(F.lit(1)) == 1
        out = out.join(covered_blocks(intervals, "_bits"), [*VIDEO, "_b"], "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_bits")
    return out.drop("_b").select(*frames.columns, *flags)


def flag_frames(frames: DataFrame, intervals: DataFrame, flag: str) -> DataFrame:
    return flags_of_frames(frames, **{flag: intervals})


def overlap_labels(frames: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    both = flags_of_frames(frames, _g=truth, _p=predicted)
    label = F.when(F.col("_g") & F.col("_p"), "both").when(F.col("_g"), "truth").when(F.col("_p"), "predicted").otherwise("none")
    return both.withColumn("label", label).drop("_g", "_p")


def interval_pairs(truth: DataFrame, predicted: DataFrame, *, min_iou: float = 0.3, tolerance: int = 0, bucket: int = INTERVAL_BUCKET) -> DataFrame:
    """Overlapping (truth, predicted) pairs with their IoU; truth is widened by the tolerance.

    Both sides are put into time buckets and joined on (video, bucket), so a video with many
    intervals spreads over tasks and is never paired with itself whole.  A pair is kept only in
    the bucket where its overlap starts.  `min_iou` must be positive.
    """
    if min_iou <= 0:
        raise ValueError("min_iou must be positive")
    g = truth.select(
        *VIDEO, F.col("jump_id").alias("gt_id"), F.col("start_frame").alias("g0"), F.col("end_frame").alias("g1"),
        (F.col("start_frame") - tolerance).alias("w0"), (F.col("end_frame") + tolerance).alias("w1"))
    p = predicted.select(
        *VIDEO, F.col("jump_id").alias("pred_id"), F.col("start_frame").alias("p0"), F.col("end_frame").alias("p1"))
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    pairs = g.withColumn("_b", spread("w0", "w1")).join(p.withColumn("_b", spread("p0", "p1")), [*VIDEO, "_b"])
    meet = F.greatest("w0", "p0")
    pairs = pairs.where((meet <= F.least("w1", "p1")) & (F.floor(meet / bucket) == F.col("_b")))
    return pairs.withColumn("iou", interval_iou("w0", "w1", "p0", "p1")).where(F.col("iou") >= min_iou).drop("_b", "w0", "w1")


def with_component(pairs: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Number the groups of pairs that touch in time.

    Pairs whose joint extents do not overlap share no interval, so greedy matching can run on each
    group by itself; a group is as long as a pile-up of overlapping intervals, not as a video.
    """
    lo, hi = F.least("g0", "p0"), F.greatest("g1", "p1")
    extent = materialize(pairs.withColumns({"_lo": lo, "_hi": hi}))
    seen = running(extent, order=("_lo", "_hi", "gt_id", "pred_id"), prior_maxes={"_max": F.col("_hi")}, chunk=chunk)
    new = F.col("_max").isNull() | (F.col("_lo") > F.col("_max"))
    return islands(seen, new, "component", order=("_lo", "_hi", "gt_id", "pred_id"), chunk=chunk).drop("_lo", "_hi", "_max")


MATCHED = ("gt_id", "pred_id", "g0", "g1", "p0", "p1", "iou")


def locally_best(pairs: DataFrame) -> DataFrame:
    """Pairs that come first for both of their intervals: no other order of decisions would drop them."""
    rank = F.struct("iou", "gt_id", "pred_id")
    ends = [pairs.groupBy(*VIDEO, end).agg(F.max(rank).alias("_b")).select(*VIDEO, F.col("_b.gt_id").alias("gt_id"), F.col("_b.pred_id").alias("pred_id")) for end in ("gt_id", "pred_id")]
    best = ends[0].join(ends[1], [*VIDEO, "gt_id", "pred_id"])
    return pairs.join(best, [*VIDEO, "gt_id", "pred_id"], "left_semi")


def greedy_matches(pairs: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """One-to-one matches, best IoU first; ties go to the larger truth and then prediction id.

    In each round the pairs that are first for both their ends are final, and those that share an interval with them go; this gives
    what taking pairs in global order gives, and a chain of overlaps through a whole video is matched in many places
    at once.  A round that does not halve what is left is the last: long falling chains, where one decision waits for the
    one before, are matched in order, each connected pile of the remaining pairs by itself.
    """
    left = materialize(pairs.select(*VIDEO, *MATCHED))
    count, found = left.count(), []
    while count:
        final = materialize(locally_best(left))
        found.append(final)
        for end in ("gt_id", "pred_id"):
            left = left.join(final.select(*VIDEO, end), [*VIDEO, end], "left_anti")
        left = materialize(left)
        remaining = left.count()
        if remaining > count / 2:
            found.append(matched_in_order(left, chunk=chunk))
            break
        count = remaining
    matched = reduce(DataFrame.unionByName, found) if found else left
    return matched.select(
        *VIDEO, "gt_id", "pred_id", "iou", F.abs(F.col("p0") - F.col("g0")).alias("start_err"), F.abs(F.col("p1") - F.col("g1")).alias("end_err"))


def matched_in_order(pairs: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """The greedy matches of each component, pair by pair.

    Components share no interval, so they are matched independently; neighbouring ones are handed
    over together, and only the ids taken so far are held.
    """

    def fold(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for c, g, p in zip(rows["component"].tolist(), rows["gt_id"].tolist(), rows["pred_id"].tolist()):
            if c != state.get("component"):
                state.update(component=c, g=set(), p=set())
            gts, preds = state["g"], state["p"]
            free = g not in gts and p not in preds
            if free:
                gts.add(g)
                preds.add(p)
            keep.append(free)
        return rows.loc[keep, [*VIDEO, *MATCHED]]

    ready = with_component(pairs, chunk=chunk).select(*VIDEO, "component", *MATCHED, F.floor(F.col("component") / COMPONENTS_PER_BLOCK).alias("_block"))
    schema = "video_id long, gt_id long, pred_id long, g0 long, g1 long, p0 long, p1 long, iou double"
    return ordered_scan(
        ready, fold, schema, keys=(*VIDEO, "_block"),
        order=("component", F.col("iou").desc(), F.col("gt_id").desc(), F.col("pred_id").desc()))


def jump_report(truth: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1 and mean errors per video; 0 where nothing can be divided."""
    key = list(VIDEO)
    g = truth.groupBy(*key).agg(F.count(F.lit(1)).alias("n_gt"))
    p = predicted.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pred"))
    m = matches.groupBy(*key).agg(
        F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("mean_iou"), F.avg("start_err").alias("mean_start_err"), F.avg("end_err").alias("mean_end_err"))
    zero = lambda c, t="double": F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c)
    out = g.join(p, key, "full").join(m, key, "left").select(
        *key, zero("n_gt", "long"), zero("n_pred", "long"), zero("tp", "long"), zero("mean_iou"), zero("mean_start_err"), zero("mean_end_err"))
    return with_rates(out)


def with_rates(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = counts.withColumns({
        "fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp"),
        "precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("n_gt"))})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", ratio(F.col("precision") * F.col("recall") * 2, both))


def jump_report_overall(per_video: DataFrame) -> DataFrame:
    """Counts pooled over the annotated videos; the mean IoU is averaged per video."""
    pooled = per_video.where("n_gt > 0").agg(
        F.sum("n_gt").alias("n_gt"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"), F.avg("mean_iou").alias("mean_iou"))
    return with_rates(pooled)


def missed_and_false(truth: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """Unmatched intervals of both sides with their length."""
    taken_g = matches.select(*VIDEO, F.col("gt_id").alias("jump_id"))
    taken_p = matches.select(*VIDEO, F.col("pred_id").alias("jump_id"))
    key = [*VIDEO, "jump_id"]
    length = (F.col("end_frame") - F.col("start_frame") + 1).alias("length")
    missed = truth.join(taken_g, key, "left_anti").select(*key, F.lit("missed").alias("kind"), length)
    false = predicted.join(taken_p, key, "left_anti").select(*key, F.lit("false").alias("kind"), length)
    return missed.unionByName(false)


def longest_detected_run(track: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Longest stretch of detected, not interpolated frames (first on ties) and its middle frame."""
    good = F.col("detected") & ~F.col("interpolated")
    runs = islands(track, ~good, "_run", chunk=chunk).where(good).groupBy(*VIDEO, "_run").agg(
        F.min(FRAME).alias("s"), F.count(F.lit(1)).alias("n"))
    best = runs.groupBy(*VIDEO).agg(F.max(F.struct("n", -F.col("s"))).alias("b"))
    start, n = -F.col("b.col2"), F.col("b.n")
    return best.select(*VIDEO, start.alias("start_frame"), n.alias("length"), (start + F.floor(n / 2)).alias("seed_frame"))


def interpolated_stretches(track: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Runs of consecutive interpolated frames; a run ends where a frame is missing or seen."""
    gap = F.col("interpolated") & ~F.col("detected")
    cut = islands(track, ~gap, "_run", chunk=chunk).where(gap)
    return cut.groupBy(*VIDEO, "_run").agg(
        F.min(FRAME).alias("start_frame"), F.max(FRAME).alias("end_frame"), F.count(F.lit(1)).alias("length")).drop("_run")


def detections_in_stretches(stretches: DataFrame, seen: DataFrame, spine: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Detected frames inside each stretch as a difference of prefix counts, without a range join.

    `spine` must have every frame of the video; `seen` has the detected ones.
    """
    marks = spine.select(*VIDEO, FRAME).join(seen.select(*VIDEO, FRAME).distinct().withColumn("_s", F.lit(1)), [*VIDEO, FRAME], "left")
    counted = running(marks, sums={"_c": F.coalesce("_s", F.lit(0))}, chunk=chunk)
    at_end = counted.select(*VIDEO, F.col(FRAME).alias("end_frame"), F.col("_c").alias("_e"))
    at_start = counted.select(*VIDEO, F.col(FRAME).alias("start_frame"), (F.col("_c") - F.coalesce("_s", F.lit(0))).alias("_b"))
    return (
        stretches.join(at_end, [*VIDEO, "end_frame"]).join(at_start, [*VIDEO, "start_frame"])
        .withColumn("n_detected", F.col("_e") - F.col("_b")).drop("_e", "_b"))


def top_stretches(stretches: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy(*VIDEO).orderBy(F.col("length").desc(), "start_frame")
    return stretches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def error_episodes(errors: DataFrame, *, limit: float = 100.0, max_gap: int = 20, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Large errors grouped while their frames are less than `max_gap` apart."""
    large = materialize(errors.where(F.col("error") > limit))
    stepped = running(large, prevs={"_p": F.col(FRAME)}, chunk=chunk)
    new = F.col("_p").isNull() | (F.col(FRAME) - F.col("_p") >= max_gap)
    return islands(stepped, new, "episode", chunk=chunk).drop("_p")


def episode_summary(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy(*VIDEO, "episode").agg(
        F.min(FRAME).alias("start_frame"), F.max(FRAME).alias("end_frame"), (F.max(FRAME) - F.min(FRAME) + 1).alias("span"),
        F.count(F.lit(1)).alias("n_errors"), F.avg("error").alias("mean_error"), F.count_if("detected").alias("n_detected"))


def episode_heads(episodes: DataFrame, n: int = 5) -> DataFrame:
    """First n errors of each episode."""
    w = Window.partitionBy(*VIDEO, "episode").orderBy(FRAME)
    return episodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def crowded_error_frames(errors: DataFrame, detections: DataFrame, *, limit: float = 100.0) -> DataFrame:
    """Per video: frames with a large error, and how many of them had several persons."""
    counts = detections.groupBy(*VIDEO, FRAME).agg(F.count(F.lit(1)).alias("_c"))
    large = errors.where(F.col("error") > limit).select(*VIDEO, FRAME).join(counts, [*VIDEO, FRAME], "left")
    return large.groupBy(*VIDEO).agg(F.count(F.lit(1)).alias("n_errors"), F.count_if(F.col("_c") > 1).alias("n_crowded"))


def zone_counts(track: DataFrame, first: int, last: int) -> DataFrame:
    """Detected and interpolated frames inside a frame range."""
    return track.where(F.col(FRAME).between(first, last)).groupBy(*VIDEO).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("n_detected"), F.count_if("interpolated").alias("n_interpolated"))
