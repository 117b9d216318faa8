"""From matches and flow to map positions: votes, anchors, calibration and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import affine, clip, distance
from trackweave.operators.evaluate import bracket, distribution
from trackweave.operators.interpolate import (
    VENUE, held_out_extrapolated, held_out_spline, pchip_slopes, spline_between, with_neighbours)
from trackweave.operators.series import CHUNK_FRAMES, FRAME, VIDEO, running, with_position
from trackweave.session import materialize


def linear_fit(points: DataFrame, x: str, y: str, name: str, *, keys: Sequence[str] = VIDEO) -> DataFrame:
    """y = a + b x per series; null coefficients for fewer than two points or constant x."""
    usable = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()) >= 2
    slope = F.regr_slope(F.col(y), F.col(x))
    return points.groupBy(*keys).agg(
        F.when(usable, F.regr_intercept(F.col(y), F.col(x))).alias(f"{name}_a"), F.when(usable, slope).alias(f"{name}_b"))


def rms(errors: DataFrame, column: str = "error", *, keys: Sequence[str] = VIDEO) -> DataFrame:
    return errors.groupBy(*keys).agg(F.sqrt(F.avg(F.col(column) * F.col(column))).alias("rms"))


def affine_fit(pairs: DataFrame, src: tuple[str, str], dst: tuple[str, str], *, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Least-squares affine map per series: one pass of sums, then Cramer's rule in columns.

    Sums are taken around the mean of the source points, which keeps the 2x2 system well scaled.
    Null for fewer than three pairs or collinear points.
    """
    x, y = src
    u, v = dst
    means = pairs.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(u).alias("mu"), F.avg(v).alias("mv"))
    c = pairs.join(means, list(keys)).withColumns({
        "_x": F.col(x) - F.col("mx"), "_y": F.col(y) - F.col("my"), "_u": F.col(u) - F.col("mu"), "_v": F.col(v) - F.col("mv")})
    prod = lambda p, q, n: F.sum(F.col(p) * F.col(q)).alias(n)
    s = c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.first(m).alias(m) for m in ("mx", "my", "mu", "mv")],
        prod("_x", "_x", "xx"), prod("_x", "_y", "xy"), prod("_y", "_y", "yy"),
        prod("_x", "_u", "xu"), prod("_y", "_u", "yu"), prod("_x", "_v", "xv"), prod("_y", "_v", "yv"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    good = (F.col("n") >= 3) & (F.abs(det) > 1e-9)

    def row(xt: str, yt: str) -> tuple[Column, Column]:
        return ((F.col(xt) * F.col("yy") - F.col(yt) * F.col("xy")) / det, (F.col(yt) * F.col("xx") - F.col(xt) * F.col("xy")) / det)

    (a, b), (d, e) = row("xu", "yu"), row("xv", "yv")
    coef = {
        "m0": a, "m1": b, "m2": F.col("mu") - a * F.col("mx") - b * F.col("my"),
        "m3": d, "m4": e, "m5": F.col("mv") - d * F.col("mx") - e * F.col("my")}
    return s.select(*keys, "n", *[F.when(good, c).alias(k) for k, c in coef.items()])


def affine_residuals(pairs: DataFrame, fit: DataFrame, src: tuple[str, str], dst: tuple[str, str], *, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Mean and maximum distance between mapped and true points."""
    mapped = pairs.join(fit, list(keys)).withColumns(affine(*src, ["m0", "m1", "m2", "m3", "m4", "m5"]))
    return mapped.withColumn("_r", distance("map_x", "map_y", *dst)).groupBy(*keys).agg(
        F.avg("_r").alias("mean_residual"), F.max("_r").alias("max_residual"))


def best_scale(candidates: DataFrame) -> DataFrame:
    """Best score over the scales of each frame; the first scale wins ties."""
    rest = [c for c in candidates.columns if c not in ("video_id", FRAME, "score", "scale_idx")]
    best = candidates.groupBy(*VIDEO, FRAME).agg(
        F.max(F.struct("score", (-F.col("scale_idx")).alias("s"), *rest)).alias("b"))
    return best.select(*VIDEO, FRAME, "b.score", (-F.col("b.s")).alias("scale_idx"), *[F.col(f"b.{c}").alias(c) for c in rest])


def route_by_dark_pixels(matches: DataFrame, minimum: int) -> DataFrame:
    """Frames with too few dark pixels score -1 and are left to the second pass."""
    thin = F.col("dark_px") < minimum
    return matches.withColumn("filtered", thin).withColumn("score", F.when(thin, -1.0).otherwise(F.col("score")))


def second_pass(matches: DataFrame, sky: DataFrame, minimum: int) -> DataFrame:
    """First-pass matches with enough dark pixels, plus usable second-pass matches of the others."""
    first = matches.where(F.col("dark_px") >= minimum).withColumn("match_type", F.lit("dark"))
    thin = matches.where(F.col("dark_px") < minimum).select(*VIDEO, FRAME)
    second = sky.where(F.col("score") >= 0).join(thin, [*VIDEO, FRAME], "left_semi").withColumn("match_type", F.lit("sky_edge"))
    return first.unionByName(second)


def consistency_votes(matches: DataFrame, *, vy: str = "athlete_vy", chunk: int = CHUNK_FRAMES) -> DataFrame:
    """For each match, the number of other matches whose order in `vy` agrees with their frame order.

    Counting pairs would be quadratic.  Positions are split into halves of halves instead: a pair is
    counted once, at the level where its frames fall into sibling blocks, by a running count in the
    order of `vy`.  That is n log n rows; the running counts are cut into ranges of equally many rows, so no
    level keeps a video in one task even where all positions lie close together.
    """
    placed = with_position(matches, "_pos", chunk=chunk)
    total = matches.groupBy(*VIDEO).agg(F.count(F.lit(1)).alias("_n"))
    levels = F.greatest(F.ceil(F.log2(F.col("_n"))).cast("int"), F.lit(1))
    rows = placed.join(total, list(VIDEO)).select(
        *VIDEO, FRAME, F.col(vy).alias("_vy"), "_pos", "_n", F.explode(F.sequence(F.lit(0), levels - 1)).alias("_level"))
    half = F.expr("shiftleft(1L, _level)")
    rows = rows.withColumns({
        "_block": F.expr("shiftright(_pos, _level + 1)"), "_right": F.expr("shiftright(_pos, _level) % 2")})
    counted = running(
        materialize(rows), keys=(*VIDEO, "_level", "_block"), order=("_vy", "_right", "_pos"),
        sums={"_lefts": F.lit(1) - F.col("_right"), "_rights": F.col("_right")}, chunk=None)
    # at equal vy left rows come first: a right row sees every left one at or below it, a left row
    # sees only the right ones strictly below it
    in_right = F.greatest(F.lit(0), F.least(F.col("_n") - (F.col("_block") * 2 + 1) * half, half))
    votes = F.when(F.col("_right") == 1, F.col("_lefts")).otherwise(in_right - F.col("_rights"))
    return matches.join(counted.groupBy(*VIDEO, FRAME).agg(F.sum(votes).cast("long").alias("votes")), [*VIDEO, FRAME])


def keep_consistent(voted: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Matches with at least int(fraction x most votes); all of them when nobody has votes."""
    top = voted.groupBy(*VIDEO).agg(F.max("votes").alias("_top"))
    return voted.join(top, list(VIDEO)).where(
        (F.col("_top") == 0) | (F.col("votes") >= F.floor(F.col("_top") * F.lit(fraction)))).drop("_top")


def anchor(voted: DataFrame) -> DataFrame:
    """Most votes, then best score, then the earliest frame."""
    rest = [c for c in voted.columns if c not in ("video_id", "votes", "score", FRAME)]
    best = voted.groupBy(*VIDEO).agg(F.max(F.struct("votes", "score", (-F.col(FRAME)).alias("f"), *rest)).alias("b"))
    return best.select(*VIDEO, (-F.col("b.f")).alias(FRAME), "b.votes", "b.score", *[F.col(f"b.{c}").alias(c) for c in rest])


def best_by_score(matches: DataFrame) -> DataFrame:
    rest = [c for c in matches.columns if c not in ("video_id", "score", FRAME)]
    best = matches.groupBy(*VIDEO).agg(F.max(F.struct("score", (-F.col(FRAME)).alias("f"), *rest)).alias("b"))
    return best.select(*VIDEO, (-F.col("b.f")).alias(FRAME), "b.score", *[F.col(f"b.{c}").alias(c) for c in rest])


def calibration_pool(matches: DataFrame, anchors: DataFrame, sky_best: DataFrame, *, min_dark: int) -> DataFrame:
    """Matches with four times the dark-pixel minimum or at the anchor, plus the best sky match."""
    at = anchors.select(*VIDEO, F.col(FRAME).alias("_af"))
    dark = matches.join(at, list(VIDEO), "left").withColumn("is_anchor", F.col(FRAME) == F.col("_af")).drop("_af")
    dark = dark.where((F.col("dark_px") >= 4 * min_dark) | F.col("is_anchor")).withColumn("is_sky", F.lit(False))
    sky = sky_best.withColumns({"is_anchor": F.lit(False), "is_sky": F.lit(True)})
    return dark.unionByName(sky.select(*dark.columns))


def top_with_forced(pool: DataFrame, n: int = 20) -> DataFrame:
    """The n best by score.  A missing anchor frame takes the last place, then a missing frame of the best sky match does; of one frame in both kinds the better comes."""
    order = Window.partitionBy(*VIDEO).orderBy(F.col("score").desc(), "is_sky", FRAME)
    ranked = pool.withColumn("_r", F.row_number().over(order))
    top = ranked.where(F.col("_r") <= n)
    forced = pool.where(F.col("is_anchor") | F.col("is_sky"))
    # a frame that is among the best in either kind is not missing; at most n + 2 rows per video from here on
    missing = forced.join(top.select(*VIDEO, FRAME).distinct(), [*VIDEO, FRAME], "left_anti")
    missing = missing.groupBy(*VIDEO, FRAME).agg(F.max_by(F.struct(*[c for c in pool.columns if c not in (*VIDEO, FRAME)]), F.struct("score", ~F.col("is_sky"))).alias("_m"))
    missing = missing.select(*VIDEO, FRAME, "_m.*").select(*pool.columns)
    mine = top.select(*pool.columns, "_r").unionByName(missing.withColumn("_r", F.lit(n + 1)))
    sky = pool.where("is_sky").select(*VIDEO, F.col(FRAME).alias("_sky_frame"))
    state = mine.join(sky, list(VIDEO), "left").groupBy(*VIDEO).agg(
        # a sky frame in the last place does not give way to the anchor
        F.max(((F.col("_r") == n) & F.col(FRAME).eqNullSafe(F.col("_sky_frame"))).cast("int")).alias("_stays"),
        F.max((F.col("is_anchor") & (F.col("_r") > n)).cast("int")).alias("_add_anchor"),
        F.max((F.col("is_sky") & (F.col("_r") > n)).cast("int")).alias("_add_sky"))
    joined = mine.join(state, list(VIDEO))
    keep_top = (F.col("_r") < n) | ((F.col("_r") == n) & ((F.col("_add_anchor") + F.col("_add_sky") == 0) | (F.col("_stays") == 1)))
    keep_anchor = (F.col("_r") > n) & F.col("is_anchor") & (F.col("_add_sky") == 0) & (F.col("_stays") == 0)
    keep_sky = (F.col("_r") > n) & F.col("is_sky")
    return joined.where(keep_top | keep_anchor | keep_sky).select(*pool.columns)


def calibrate(points: DataFrame, *, chunk: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Spline anchors over cum_dy and linear fallback per video.

    The spline needs three points with distinct cum_dy; the fallback needs two points.
    """
    slopes = pchip_slopes(points.select(*VIDEO, "cum_dy", *VENUE), "cum_dy", VENUE, chunk=chunk)
    fit = points.groupBy(*VIDEO).agg(
        F.count(F.lit(1)).alias("n_cal"), (F.count_distinct("cum_dy") == F.count(F.lit(1))).alias("distinct"),
        F.min("cum_dy").alias("lo"), F.max("cum_dy").alias("hi"))
    fit = fit.join(linear_fit(points, "cum_dx", "venue_x", "x"), list(VIDEO)).join(linear_fit(points, "cum_dy", "venue_y", "y"), list(VIDEO))
    spline_ok = (F.col("n_cal") >= 3) & F.col("distinct")
    return slopes.join(fit.where(spline_ok), list(VIDEO), "left_semi"), fit.withColumn("spline_ok", spline_ok)


def predict(flow: DataFrame, points: DataFrame, *, limits: Sequence[float], chunk: float | None = None) -> DataFrame:
    """Map position of every frame: spline inside the calibrated flow range, linear outside, clipped."""
    points = materialize(points.select(*VIDEO, "cum_dx", "cum_dy", *VENUE))
    anchors, fit = calibrate(points, chunk=chunk)
    carried = [*VENUE, *[f"m_{v}" for v in VENUE]]
    around = bracket(flow.select(*VIDEO, "cum_dy").distinct(), anchors, carried, order="cum_dy", chunk=chunk).where("_a IS NOT NULL AND _b IS NOT NULL")
    inner = around.select(*VIDEO, "cum_dy", *[spline_between(v, "cum_dy").alias(f"_s_{v}") for v in VENUE])
    # frames and their splines grow with the input; Spark takes what was made from a row per video to be as small as that
    rows = flow.hint("merge").join(fit, list(VIDEO)).join(inner.hint("merge"), [*VIDEO, "cum_dy"], "left")
    inside = F.col("spline_ok") & F.col("cum_dy").between(F.col("lo"), F.col("hi"))
    out = []
    for v, axis, driver, limit in zip(VENUE, "xy", ("cum_dx", "cum_dy"), limits):
        line = F.col(f"{axis}_a") + F.col(f"{axis}_b") * F.col(driver)
        value = F.coalesce(F.when(inside, F.col(f"_s_{v}")), line)
        out.append(F.when(value.isNotNull(), clip(value, F.lit(0.0), F.lit(float(limit - 1)))).alias(v))
    return rows.select(*VIDEO, FRAME, *out)


def evaluate_positions(positions: DataFrame, truth: DataFrame, *, within: float = 50.0) -> DataFrame:
    """Per video: error statistics of predicted map positions on annotated frames."""
    t = truth.select(*VIDEO, FRAME, F.col("venue_x").alias("_tx"), F.col("venue_y").alias("_ty"))
    errors = materialize(positions.join(t, [*VIDEO, FRAME]).select(*VIDEO, FRAME, distance("venue_x", "venue_y", "_tx", "_ty").alias("error")))
    out = distribution(
        errors, "error", probs={"median": 0.5, "p90": 0.9}, extra={"within": F.avg((F.col("error") <= within).cast("double")),
                                                                   "rms": F.sqrt(F.avg(F.col("error") * F.col("error")))})
    return out.select(*VIDEO, F.col("n").alias("n_frames"), "mean", "median", "p90", "within", "rms")


def loo_by_flow(points: DataFrame, *, limits: Sequence[float], fixed_anchor: bool = False, chunk: float | None = None) -> DataFrame:
    """Error of each calibration point predicted from the others on the flow.

    The spline needs three remaining points with distinct flow and is continued beyond its ends; the
    linear fit of the remaining points (totals minus the point itself) stands in otherwise.  With
    `fixed_anchor` the earliest frame is never held out.
    """
    p = materialize(points.select(*VIDEO, FRAME, "cum_dx", "cum_dy", *VENUE))
    x, y, u, v = F.col("cum_dx"), F.col("cum_dy"), F.col("venue_x"), F.col("venue_y")
    # centred sums, so that subtracting one point loses no precision
    mean = p.groupBy(*VIDEO).agg(*[F.avg(c).alias(f"_m_{c}") for c in ("cum_dx", "cum_dy", *VENUE)], F.min(FRAME).alias("_first"))
    c = p.join(mean, list(VIDEO)).withColumns({f"_c_{k}": F.col(k) - F.col(f"_m_{k}") for k in ("cum_dx", "cum_dy", *VENUE)})
    s = lambda a, b, n: F.sum(F.col(f"_c_{a}") * F.col(f"_c_{b}")).alias(n)
    tot = c.groupBy(*VIDEO).agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("cum_dy").alias("_nd"), s("cum_dx", "cum_dx", "_xx"), s("cum_dx", "venue_x", "_xu"),
        s("cum_dy", "cum_dy", "_yy"), s("cum_dy", "venue_y", "_yv"))
    same = p.groupBy(*VIDEO, "cum_dy").agg(F.count(F.lit(1)).alias("_same"))
    rows = with_neighbours(c, "cum_dy", 3, carry=VENUE, chunk=chunk).join(tot, list(VIDEO)).join(same, [*VIDEO, "cum_dy"])
    left = F.col("_n") - 1

    def refit(axis: str, target: str, sxx: str, sxy: str) -> Column:
        a, b = F.col(f"_c_{axis}"), F.col(f"_c_{target}")
        # removing one centred point shifts the means by -a/(n-1) and the sums by n/(n-1) of its products
        grow = F.col("_n") / left
        slope = (F.col(sxy) - grow * a * b) / (F.col(sxx) - grow * a * a)
        return F.col(f"_m_{target}") - b / left + slope * (a + a / left)

    remaining_distinct = F.col("_nd") - F.when(F.col("_same") == 1, 1).otherwise(0) == left
    spline = (left >= 3) & remaining_distinct
    out = []
    for value, axis, sxx, sxy, limit in zip(VENUE, ("cum_dx", "cum_dy"), ("_xx", "_yy"), ("_xu", "_yv"), limits):
        curve = F.coalesce(held_out_spline(y, value), held_out_extrapolated(y, value))
        pred = F.when(spline, curve).when(left >= 2, refit(axis, value, sxx, sxy))
        out.append(F.when(pred.isNotNull() & ~F.isnan(pred), clip(pred, F.lit(0.0), F.lit(float(limit - 1)))))
    scored = rows.withColumn("error", distance(out[0], out[1], u, v))
    if fixed_anchor:
        scored = scored.where(F.col(FRAME) != F.col("_first"))
    return scored.select(*VIDEO, FRAME, "error")


def calibrate_from_matches(
    matches: DataFrame, sky: DataFrame, flow: DataFrame, *, min_dark: int, limits: Sequence[float], top: int = 20, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Matches to map positions: votes, anchor, pool, best n, consistency filter, spline on flow."""
    good = materialize(matches.where(F.col("dark_px") >= min_dark))
    anchors = anchor(consistency_votes(good, chunk=chunk))
    pool = materialize(calibration_pool(good, anchors, best_by_score(sky), min_dark=min_dark))
    kept = top_with_forced(pool, top).drop("votes")
    steady = keep_consistent(consistency_votes(kept, chunk=chunk))
    # a frame is one calibration point: of its dark and its sky match the later one in order of score
    later = F.max_by(F.struct("athlete_vx", "athlete_vy"), F.struct(-F.col("score"), "is_sky"))
    steady = steady.groupBy(*VIDEO, FRAME).agg(later.alias("m")).select(*VIDEO, FRAME, "m.*")
    flow = materialize(flow.select(*VIDEO, FRAME, "cum_dx", "cum_dy"))
    points = steady.join(flow, [*VIDEO, FRAME]).select(
        *VIDEO, FRAME, "cum_dx", "cum_dy", F.col("athlete_vx").alias("venue_x"), F.col("athlete_vy").alias("venue_y"))
    return predict(flow, points, limits=limits)
