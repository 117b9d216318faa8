"""Keyframe interpolation: monotone cubic, trends, arc length, and leave-one-out versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.geometry import clip, distance
from trackweave.functions.spline import end_slope, hermite, interior_slope
from trackweave.operators.evaluate import bracket, distribution
from trackweave.operators.series import CHUNK_FRAMES, FRAME, VIDEO, halo_window, running, with_position
from trackweave.session import materialize

VENUE = ("venue_x", "venue_y")


def with_neighbours(keyframes: DataFrame, x: str, reach: int, *, keys: Sequence[str] = VIDEO, carry: Sequence[str] = (), chunk: float | None = CHUNK_FRAMES) -> DataFrame:
    """Add `_p1.._pr` and `_n1.._nr`, structs of the neighbouring keyframes in the order of `x`."""
    placed = with_position(keyframes, "_pos", keys=keys, order=x, chunk=chunk)
    me = F.struct(F.col(x).cast("double").alias("x"), *[F.col(c) for c in carry])

    def columns(w) -> Mapping[str, Column]:
        back = {f"_p{i}": F.lag(me, i).over(w) for i in range(1, reach + 1)}
        return {**back, **{f"_n{i}": F.lead(me, i).over(w) for i in range(1, reach + 1)}}

    return halo_window(placed, columns, keys=keys, pos="_pos", before=reach, after=reach, chunk=max(int(chunk or CHUNK_FRAMES), reach)).drop("_pos")


def pchip_slopes(keyframes: DataFrame, x: str = FRAME, values: Sequence[str] = VENUE, *, keys: Sequence[str] = VIDEO, chunk: float | None = CHUNK_FRAMES) -> DataFrame:
    """Monotone slope `m_<value>` at every keyframe; null for a series of one."""
    near = with_neighbours(keyframes, x, 2, keys=keys, carry=values, chunk=chunk)
    here = F.col(x).cast("double")

    def pts(v: str, *sides: str) -> list[Column]:
        return [c for s in sides for c in (F.col(s)["x"], F.col(s)[v])]

    slopes = {}
    for v in values:
        me = [here, F.col(v)]
        slopes[f"m_{v}"] = (
            F.when(F.col("_p1").isNotNull() & F.col("_n1").isNotNull(), interior_slope(*pts(v, "_p1"), *me, *pts(v, "_n1")))
            .when(F.col("_n1").isNotNull(), end_slope(*me, *pts(v, "_n1", "_n2")))
            .when(F.col("_p1").isNotNull(), end_slope(*me, *pts(v, "_p1", "_p2")))
        )
    return near.withColumns(slopes).drop("_p1", "_p2", "_n1", "_n2")


def spline_between(value: str, x: str = FRAME) -> Column:
    """Spline value between the anchors `_a` and `_b` that carry slopes."""
    a, b = F.col("_a"), F.col("_b")
    at = F.col(x).cast("double")
    inner = hermite(at, a[x].cast("double"), a[value], a[f"m_{value}"], b[x].cast("double"), b[value], b[f"m_{value}"])
    return F.when(a[x] == b[x], a[value]).otherwise(inner)


def end_trends(keyframes: DataFrame, values: Sequence[str] = VENUE, *, keys: Sequence[str] = VIDEO, order: str = FRAME) -> DataFrame:
    """First two and last two keyframes per series (`_f0`, `_f1`, `_l1`, `_l0`), for extrapolation."""
    me = F.struct(F.col(order), *values)
    bounds = keyframes.groupBy(*keys).agg(F.min(me).alias("_f0"), F.max(me).alias("_l0"))
    joined = keyframes.join(bounds, list(keys))
    inner = joined.groupBy(*keys).agg(
        F.min(F.when(F.col(order) > F.col("_f0")[order], me)).alias("_f1"),
        F.max(F.when(F.col(order) < F.col("_l0")[order], me)).alias("_l1"))
    return bounds.join(inner, list(keys))


def trend(value: str, near: str, far: str, order: str = FRAME) -> Column:
    """Line through the outermost keyframe `near` and its neighbour; constant without a neighbour."""
    n, f = F.col(near), F.col(far)
    line = n[value] + (F.col(order) - n[order]) / (f[order] - n[order]) * (f[value] - n[value])
    return F.when(f.isNull(), n[value]).otherwise(line)


def project_to_map(
    frames: DataFrame, keyframes: DataFrame, values: Sequence[str] = VENUE, *, limits: Sequence[float],
    mode: str = "pchip", keys: Sequence[str] = VIDEO, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Position of every frame: exact at keyframes, interpolated between, trend outside.

    `limits` are the map's width and height; everything but the exact keyframes is clipped to
    [0, limit - 1].  Series without keyframes get zeros.
    """
    if mode not in ("pchip", "linear"):
        raise ValueError(f"unknown interpolation mode {mode!r}")
    keys = list(keys)
    anchors = keyframes.select(*keys, FRAME, *values)
    carried = [*values]
    if mode == "pchip":
        anchors = pchip_slopes(anchors, FRAME, values, keys=keys, chunk=chunk)
        carried += [f"m_{v}" for v in values]
    around = bracket(frames, anchors, carried, keys=keys, chunk=chunk)
    rows = around.join(end_trends(keyframes, values, keys=keys), keys, "left")
    a, b = F.col("_a"), F.col("_b")
    out = []
    for v, limit in zip(values, limits):
        if mode == "pchip":
            inner = spline_between(v)
        else:
            inner = a[v] + (F.col(FRAME) - a[FRAME]) / (b[FRAME] - a[FRAME]) * (b[v] - a[v])
        lone = F.col("_f1").isNull()
        moved = F.when(a.isNull(), trend(v, "_f0", "_f1")).when(b.isNull(), trend(v, "_l0", "_l1")).otherwise(inner)
        value = (
            F.when(a.isNull() & b.isNull(), F.lit(0.0)).when(a[FRAME] == b[FRAME], a[v])
            .when(lone, F.coalesce(a[v], b[v])).otherwise(clip(moved, F.lit(0.0), F.lit(float(limit - 1))))
        )
        out.append(value.alias(v))
    return rows.select(*keys, FRAME, *out)


def keyframe_gaps(keyframes: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Frames to the previous and next keyframe, 0 at the ends."""
    g = running(keyframes, prevs={"_p": F.col(FRAME)}, nexts={"_n": F.col(FRAME)}, chunk=chunk)
    zero = F.lit(0).cast("long")
    return g.withColumns({
        "gap_before": F.coalesce(F.col(FRAME) - F.col("_p"), zero), "gap_after": F.coalesce(F.col("_n") - F.col(FRAME), zero)}).drop("_p", "_n")


def arc_interpolation(
    frames: DataFrame, keyframes: DataFrame, arcs: DataFrame, values: Sequence[str] = VENUE, *, limits: Sequence[float],
    keys: Sequence[str] = VIDEO, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Between keyframes, progress follows the path length of the track.

    Without motion the middle is taken; where a frame or keyframe has no path length, progress
    follows the frame number.
    """
    keys = list(keys)
    anchors = keyframes.join(arcs.select(*keys, FRAME, "arc"), [*keys, FRAME], "left")
    around = bracket(frames, anchors, [*values, "arc"], keys=keys, chunk=chunk).where("_a IS NOT NULL AND _b IS NOT NULL")
    rows = around.join(arcs.select(*keys, FRAME, "arc"), [*keys, FRAME], "left")
    a, b = F.col("_a"), F.col("_b")
    span = b["arc"] - a["arc"]
    by_arc = F.when(span > 0, (F.col("arc") - a["arc"]) / span).otherwise(F.lit(0.5))
    by_frame = (F.col(FRAME) - a[FRAME]) / (b[FRAME] - a[FRAME])
    t = clip(F.when(span.isNotNull() & F.col("arc").isNotNull(), by_arc).otherwise(by_frame), F.lit(0.0), F.lit(1.0))
    out = [
        F.when(a[FRAME] == b[FRAME], a[v]).otherwise(clip(a[v] + t * (b[v] - a[v]), F.lit(0.0), F.lit(float(limit - 1)))).alias(v)
        for v, limit in zip(values, limits)]
    return rows.select(*keys, FRAME, *out)


def nearest_arc(keyframes: DataFrame, arcs: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Path length at each keyframe, taken from the nearest tracked frame (the earlier on ties)."""
    around = bracket(keyframes, arcs, ["arc"], chunk=chunk)
    a, b = F.col("_a"), F.col("_b")
    later = a.isNull() | (b[FRAME] - F.col(FRAME) < F.col(FRAME) - a[FRAME])
    return around.select(*VIDEO, FRAME, F.when(later, b["arc"]).otherwise(a["arc"]).alias("arc"))


def evenly_spaced(keyframes: DataFrame, sizes: Sequence[int | None], *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Subsets of the keyframes, one per size (`None` keeps all), as rows tagged `size`.

    One keyframe is the middle one; n keyframes sit at the half-even rounded positions i(N-1)/(n-1).
    """
    placed = with_position(keyframes, "_i", chunk=chunk)
    total = keyframes.groupBy(*VIDEO).agg(F.count(F.lit(1)).alias("_t"))
    rows = placed.join(total, list(VIDEO))
    i, t = F.col("_i"), F.col("_t")
    picks = []
    for n in sizes:
        if n is None:
            picks.append(F.lit(0))
        elif n == 1:
            picks.append(F.when((t <= 1) | (i == F.floor(t / 2)), F.lit(1)))
        else:
            spots = F.array(*[F.rint(F.lit(k) * (t - 1) / F.lit(n - 1)).cast("long") for k in range(n)])
            picks.append(F.when((t <= n) | F.array_contains(spots, i), F.lit(n)))
    tags = F.array_compact(F.array(*picks))
    return rows.withColumn("size", F.explode(tags)).withColumn("size", F.col("size").cast("long")).drop("_i", "_t")


# ------------------------------------------------------------------ leave one out


def _point(side: str, value: str) -> list[Column]:
    return [F.col(side)["x"], F.col(side)[value]]


def held_out_spline(x: Column, value: str) -> Column:
    """Spline through the neighbours of a keyframe that is itself left out; null at the ends.

    Only two neighbours on each side shape it, so no fold is ever materialised.
    """
    before, after = F.col("_p2").isNotNull(), F.col("_n2").isNotNull()
    p1, n1, p2, n2 = (_point(s, value) for s in ("_p1", "_n1", "_p2", "_n2"))
    m0 = F.when(before, interior_slope(*p2, *p1, *n1)).otherwise(end_slope(*p1, *n1, *n2))
    m1 = F.when(after, interior_slope(*p1, *n1, *n2)).otherwise(end_slope(*n1, *p1, *p2))
    inside = F.col("_p1").isNotNull() & F.col("_n1").isNotNull()
    return F.when(inside, hermite(x, *p1, m0, *n1, m1))


def held_out_line(x: Column, value: str) -> Column:
    p, n = F.col("_p1"), F.col("_n1")
    return F.when(p.isNotNull() & n.isNotNull(), p[value] + (x - p["x"]) / (n["x"] - p["x"]) * (n[value] - p[value]))


def held_out_trend(x: Column, value: str) -> Column:
    """Beyond the remaining keyframes: line through the two nearest ones, or the only one."""
    def line(near: str, far: str) -> Column:
        n, f = F.col(near), F.col(far)
        return F.when(f.isNull(), n[value]).otherwise(n[value] + (x - n["x"]) / (f["x"] - n["x"]) * (f[value] - n[value]))

    return F.when(F.col("_p1").isNull(), line("_n1", "_n2")).when(F.col("_n1").isNull(), line("_p1", "_p2"))


def held_out_extrapolated(x: Column, value: str) -> Column:
    """Beyond the remaining keyframes: the outermost cubic piece continued."""
    def piece(a: str, b: str, c: str) -> Column:
        pa, pb, pc = (_point(s, value) for s in (a, b, c))
        third = F.col(c).isNotNull()
        inner = F.when(third, interior_slope(*pa, *pb, *pc)).otherwise(end_slope(*pb, *pa, F.lit(None).cast("double"), F.lit(None).cast("double")))
        return hermite(x, *pa, end_slope(*pa, *pb, *pc), *pb, inner)

    # interior_slope takes its points in rising x; on the right side the chain is walked backwards,
    # which leaves secants unchanged and flips both widths, so the formula still holds
    return F.when(F.col("_p1").isNull(), piece("_n1", "_n2", "_n3")).when(F.col("_n1").isNull(), piece("_p1", "_p2", "_p3"))


def loo_by_frame(
    keyframes: DataFrame, values: Sequence[str] = VENUE, *, limits: Sequence[float], arcs: DataFrame | None = None, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Error at every keyframe predicted from the others: linear, spline and, with arcs, path length.

    Ends are extrapolated by the trend.  A lone keyframe has no prediction.
    """
    rows = keyframes.select(*VIDEO, FRAME, *values)
    carry = [*values]
    if arcs is not None:
        rows = rows.join(arcs.select(*VIDEO, FRAME, "arc"), [*VIDEO, FRAME], "left")
        carry.append("arc")
    near = with_neighbours(materialize(rows), FRAME, 2, carry=carry, chunk=chunk)
    x = F.col(FRAME).cast("double")

    def bounded(value: Column, limit: float) -> Column:
        return F.when(value.isNotNull(), clip(value, F.lit(0.0), F.lit(float(limit - 1))))

    methods = {"linear": held_out_line, "pchip": held_out_spline}
    if arcs is not None:
        def by_arc(at: Column, value: str) -> Column:
            p, n = F.col("_p1"), F.col("_n1")
            span = n["arc"] - p["arc"]
            t = F.when(span.isNotNull() & F.col("arc").isNotNull(), F.when(span > 0, (F.col("arc") - p["arc"]) / span).otherwise(F.lit(0.5)))
            t = clip(F.coalesce(t, (at - p["x"]) / (n["x"] - p["x"])), F.lit(0.0), F.lit(1.0))
            return F.when(p.isNotNull() & n.isNotNull(), p[value] + t * (n[value] - p[value]))

        methods["arc"] = by_arc
    for name, method in methods.items():
        pred = [bounded(F.coalesce(method(x, v), held_out_trend(x, v)), lim) for v, lim in zip(values, limits)]
        near = near.withColumn(f"err_{name}", distance(pred[0], pred[1], *values))
    gap = lambda side: F.coalesce(F.abs(F.col(side)["x"] - x), F.lit(0.0)).cast("long")
    return near.select(*VIDEO, FRAME, gap("_p1").alias("gap_before"), gap("_n1").alias("gap_after"), *[f"err_{m}" for m in methods])


def loo_summary(errors: DataFrame, columns: Sequence[str], *, within: float = 50.0, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Mean, median, p90, maximum and share within the limit for each error column, in long form."""
    rows = F.array(*[F.struct(F.lit(c).alias("method"), F.col(c).alias("error")) for c in columns])
    long = materialize(errors.select(*keys, F.inline(rows)).where("error IS NOT NULL"))
    out = distribution(
        long, "error", [*keys, "method"], probs={"median": 0.5, "p90": 0.9},
        extra={"within": F.avg((F.col("error") <= within).cast("double"))})
    return out.select(*keys, "method", "n", "mean", "median", "p90", "max", "within")


def method_winners(errors: DataFrame, first: str, second: str, *, tolerance: float = 1.0) -> DataFrame:
    """Per row: which of two errors is smaller by more than the tolerance."""
    a, b = F.col(first), F.col(second)
    return errors.withColumn(
        "winner", F.when(b < a - tolerance, F.lit(second)).when(a < b - tolerance, F.lit(first)).otherwise(F.lit("tie")))


def best_method(errors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per row: the column with the smallest error, missing ones last, the first listed on ties."""
    filled = [F.coalesce(F.nanvl(F.col(c), F.lit(1e9)), F.lit(1e9)) for c in columns]
    least = F.least(*filled)
    pick = F.lit(columns[-1])
    for c, v in reversed(list(zip(columns[:-1], filled[:-1]))):
        pick = F.when(v == least, F.lit(c)).otherwise(pick)
    return errors.withColumn("best", pick)


def sparsity_study(
    frames: DataFrame, keyframes: DataFrame, sizes: Sequence[int | None] = (1, 2, 3, 5, 7, 10, None), values: Sequence[str] = VENUE, *,
    chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Error against densely interpolated truth when only n keyframes are kept, all sizes in one job.

    Outside the kept keyframes the nearest one is held.
    """
    keys = ["video_id", "size"]
    kept = materialize(evenly_spaced(keyframes, sizes, chunk=chunk))
    dense = bracket(frames, keyframes, values, chunk=chunk).where("_a IS NOT NULL AND _b IS NOT NULL")
    a, b = F.col("_a"), F.col("_b")

    def line(v: str) -> Column:
        t = (F.col(FRAME) - a[FRAME]) / (b[FRAME] - a[FRAME])
        return F.when(a.isNull(), b[v]).when(b.isNull() | (a[FRAME] == b[FRAME]), a[v]).otherwise(a[v] + t * (b[v] - a[v]))

    truth = dense.select(*VIDEO, FRAME, *[line(v).alias(f"true_{v}") for v in values])
    tags = F.array(*[F.lit(0 if n is None else n).cast("long") for n in sizes])
    spread = truth.withColumn("size", F.explode(tags))
    pred = bracket(spread, kept.select(*keys, FRAME, *values), values, keys=keys, chunk=chunk)
    joined = spread.join(pred, [*keys, FRAME]).select(*keys, FRAME, *[line(v).alias(v) for v in values], *[f"true_{v}" for v in values])
    errors = joined.withColumn("error", distance(values[0], values[1], f"true_{values[0]}", f"true_{values[1]}"))
    return loo_summary(errors, ["error"], keys=keys).drop("method")
