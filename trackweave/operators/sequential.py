"""Order-dependent operators: conflict resolution, identity guard, flow traces, flow fill, smoothing.

What can be decided without the past (quality, gates, distances to the trace) is computed as columns first.  Recurrences whose
steps compose (traces along the flow, the point filter) are prefix compositions and stay in the JVM.  The others are small folds
over pieces of a video that run side by side and hand their state on until it agrees (`series.handed_over`), with the
result of one pass.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import clamp_box, distance, quality, with_box_geometry
from trackweave.operators.evaluate import distance_summary
from trackweave.operators.gapfill import BOX, around_gaps, gap_columns, linear_box, short_gap_or_flow
from trackweave.operators.kinematics import merge_traces
from trackweave.operators.series import (
    CHUNK_FRAMES, FRAME, PIECE_FRAMES, RUN_IN, VIDEO, halo_chunks, halo_window, handed_over, ordered_scan, prefix_composed, running, with_position)
from trackweave.session import materialize


# ---------------------------------------------------------------- conflict resolution


@dataclass(frozen=True)
class ResolverParams:
    w_conf: float = 0.3
    w_center: float = 0.5
    w_continuity: float = 0.6
    w_stickiness: float = 0.4
    w_agreement: float = 1.5
    w_velocity: float = 0.4
    w_size: float = 0.0
    history: int = 5
    radius: float = 150.0
    synthetic_confidence: float = 0.3
    gate: bool = False
    conflict_spread: float = 100.0
    conflict_agreement: float = 1.0
    conflict_stickiness: float = 1.0
    conflict_velocity: float = 1.0


AREA_HISTORY = 50
CANDIDATE_FIELDS = (*BOX, "confidence", "track_id", "det_no", "quality", "near")


def candidate_frames(candidates: DataFrame, trace: DataFrame | None, videos: DataFrame, params: ResolverParams = ResolverParams()) -> DataFrame:
    """One row per frame with its candidates as parallel arrays (a frame has a handful of them).

    Order inside a frame is (`order`, det_no) when the candidates carry an `order`, else det_no.
    """
    order = ["order", "det_no"] if "order" in candidates.columns else ["det_no"]
    c = with_box_geometry(candidates).join(videos.select(*VIDEO, "img_w", "img_h"), list(VIDEO))
    if trace is not None:
        c = c.join(trace.select(*VIDEO, FRAME, "trace_x", "trace_y"), [*VIDEO, FRAME], "left")
    else:
        c = c.withColumns({"trace_x": F.lit(None).cast("double"), "trace_y": F.lit(None).cast("double")})
    near = F.coalesce(distance("cx", "cy", "trace_x", "trace_y") < params.radius * 2, F.lit(True))
    fields = F.struct(
        *order, *[F.col(b).cast("double").alias(f"_{b}") for b in BOX], F.col("confidence").alias("_confidence"),
        F.coalesce(F.col("track_id"), F.lit(-1)).cast("double").alias("_track_id"), F.col("det_no").cast("double").alias("_det_no"),
        quality("confidence", "cx", "cy", "img_w", "img_h", params.w_conf, params.w_center).alias("_quality"),
        near.cast("double").alias("_near"))
    out = c.groupBy(*VIDEO, FRAME).agg(
        F.sort_array(F.collect_list(fields)).alias("_c"), F.first("trace_x").alias("trace_x"), F.first("trace_y").alias("trace_y"),
        F.first("img_w").alias("img_w"), F.first("img_h").alias("img_h"), F.count(F.lit(1)).alias("n_candidates"), F.count_if(near).alias("n_near"))
    return out.select(
        *VIDEO, FRAME, "trace_x", "trace_y", "img_w", "img_h", "n_candidates", "n_near",
        *[F.transform("_c", _picker(f"_{f}")).alias(f) for f in CANDIDATE_FIELDS])


def _picker(field: str):
    return lambda s: s[field]


def velocity_score(history, vx: float, vy: float) -> float:
    """Agreement of a velocity with the recency-weighted mean of the last ones, oldest first."""
    n = len(history)
    if n < 3:
        return 0.5
    total = n * (n + 1) / 2
    px = sum((i + 1) * v[0] for i, v in enumerate(history)) / total
    py = sum((i + 1) * v[1] for i, v in enumerate(history)) / total
    p, c = math.hypot(px, py), math.hypot(vx, vy)
    if p < 1e-6 or c < 1e-6:
        direction = 0.0 if p > 2 and c < 1 else 0.5
    else:
        direction = max(0.0, ((px * vx + py * vy) / (p * c) + 1) / 2)
    if p < 1e-6:
        size = 1.0 if c < 2 else max(0.0, 1 - c / 50)
    else:
        size = max(0.0, 1 - abs(c - p) / (p + 1e-6))
    return 0.65 * direction + 0.35 * size


def _resolver_fold(variants: Sequence[ResolverParams]):
    """The fold over the rows of one video and variant, which is the place of its parameters in the list."""
    columns = [*VIDEO, "variant", FRAME, *BOX, "confidence", "track_id", "det_no", "of_synthetic", "n_candidates", "conflict", "of_known", "margin"]

    def fold(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        p = variants[int(rows["variant"].iloc[0])]

        def closeness(cx: float, cy: float, tx: float, ty: float) -> float:
            return max(0.0, 1.0 - math.hypot(cx - tx, cy - ty) / p.radius)

        for row in rows.itertuples(index=False):
            if state.get("pos") != row.pos - 1:  # the rows left out in between are sure, and so are the first ones here
                state.clear()
            state["pos"] = row.pos
            if not isinstance(state.get("moves"), deque):
                state["moves"] = deque(state.get("moves", ()), maxlen=p.history)
                state["areas"] = deque(state.get("areas", ()), maxlen=AREA_HISTORY)
            box = list(zip(*[getattr(row, b).tolist() for b in BOX]))
            conf, tid, det, qual = row.confidence.tolist(), row.track_id.tolist(), row.det_no.tolist(), row.quality.tolist()
            known = not math.isnan(row.trace_x)
            prev = state.get("box")
            keep = range(len(box))
            if p.gate and known:
                near = [i for i, flag in enumerate(row.near) if flag]
                if near:
                    keep = near
                elif prev is not None and p.synthetic_confidence > 0:
                    w, h = prev[2] - prev[0], prev[3] - prev[1]
                    x1, y1 = round(row.trace_x - w / 2), round(row.trace_y - h / 2)
                    mx, my = row.img_w / 2, row.img_h / 2
                    near_centre = 1 - math.hypot(x1 + w / 2 - mx, y1 + h / 2 - my) / math.hypot(mx, my)
                    box.append((x1, y1, x1 + w, y1 + h))
                    conf.append(p.synthetic_confidence)
                    tid.append(-1.0)
                    det.append(math.nan)
                    qual.append(p.w_conf * p.synthetic_confidence + p.w_center * near_centre)
                    keep = range(len(box))
            centre = [((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for b in box]
            before = ((prev[0] + prev[2]) / 2, (prev[1] + prev[3]) / 2) if prev is not None else None
            conflict, of_known, margin = False, False, math.nan
            if len(keep) == 1:
                best = keep[0]
                b = box[best]
                state["areas"].append(max(1.0, (b[2] - b[0]) * (b[3] - b[1])))
            else:
                xs, ys = [centre[i][0] for i in keep], [centre[i][1] for i in keep]
                conflict = max(max(xs) - min(xs), max(ys) - min(ys)) > p.conflict_spread
                of_known = conflict and known
                agreement = p.w_agreement * (p.conflict_agreement if of_known else 1.0)
                stickiness = p.w_stickiness * (p.conflict_stickiness if of_known else 1.0)
                velocity = p.w_velocity * (p.conflict_velocity if of_known else 1.0)
                expected = state.get("trace")
                areas = state["areas"]
                mean_area = sum(areas) / len(areas) if p.w_size > 0 and len(areas) >= 5 else None
                best, top, second = None, -1.0, -1.0
                for i in keep:
                    cx, cy = centre[i]
                    total = qual[i]
                    total += p.w_continuity * (closeness(cx, cy, *expected) if expected else 0.5)
                    if state.get("tid", -1.0) >= 0 and tid[i] == state["tid"]:
                        total += stickiness
                    if known and not math.isnan(det[i]):
                        total += agreement * closeness(cx, cy, row.trace_x, row.trace_y)
                    total += velocity * (velocity_score(state["moves"], cx - before[0], cy - before[1]) if before else 0.5)
                    if p.w_size > 0:
                        size = 0.5
                        if mean_area is not None:
                            b = box[i]
                            ratio = math.log(max(1.0, (b[2] - b[0]) * (b[3] - b[1])) / mean_area)
                            size = math.exp(-0.5 * ratio * ratio / 0.25)
                        total += p.w_size * size
                    if total > top:
                        best, top, second = i, total, top
                    elif total > second:
                        second = total
                if conflict and second > -1.0:
                    margin = top - second
            if before is not None:
                state["moves"].append((centre[best][0] - before[0], centre[best][1] - before[1]))
            state["box"], state["tid"] = box[best], tid[best]
            state["trace"] = (row.trace_x, row.trace_y) if known else None
            synthetic = math.isnan(det[best])
            out.append((row.video_id, row.variant, row.frame_id, *[int(v) for v in box[best]], conf[best], tid[best] if tid[best] >= 0 else math.nan,
                        det[best], synthetic, len(keep), conflict, of_known, margin))
        return pd.DataFrame(out, columns=columns)

    return fold


RESOLVED = (
    "video_id long, variant int, frame_id long, x1 long, y1 long, x2 long, y2 long, confidence double, track_id double, det_no double, "
    "of_synthetic boolean, n_candidates long, conflict boolean, of_known boolean, margin double")


def resolve_conflicts(frames: DataFrame, params: ResolverParams = ResolverParams(), *, chunk: int = CHUNK_FRAMES, piece: int = PIECE_FRAMES) -> DataFrame:
    """One observation per frame, chosen by quality, continuity, stickiness, flow and motion."""
    return resolve_variants(frames, [params], chunk=chunk, piece=piece).drop("variant")


def resolve_variants(frames: DataFrame, variants: Sequence[ResolverParams], *, chunk: int = CHUNK_FRAMES, piece: int = PIECE_FRAMES) -> DataFrame:
    """One observation per frame and variant (its place in `variants`), all variants in one job.

    The state is the previous choice, the last velocities and (when sizes count) the last areas.  Frames with a single sure candidate
    need no state, and a run of them refills all of it: they stay in the JVM, but for the run that leads up to a contested frame.
    Contested stretches are folded in pieces that hand their state on.  Variants share the candidates, so they must agree in what
    those depend on: weights of quality, radius and gate.
    """
    params = variants[0]
    if any((v.w_conf, v.w_center, v.radius, v.gate) != (params.w_conf, params.w_center, params.radius, params.gate) for v in variants):
        raise ValueError("variants must share w_conf, w_center, radius and gate")
    single = (F.col("n_candidates") == 1)
    if params.gate:
        single = ((F.col("trace_x").isNull()) & single) | (F.col("trace_x").isNotNull() & (F.col("n_near") == 1))
    need = max(max(v.history + 1, AREA_HISTORY if v.w_size > 0 else 0) for v in variants)
    placed = with_position(materialize(frames).withColumn("_single", single), "pos", chunk=chunk)
    every = F.explode(F.array(*[F.lit(i) for i in range(len(variants))])).alias("variant")

    def contested(w):
        return {"_asked": F.max((~F.col("_single")).cast("int")).over(w.rowsBetween(0, need)) == 1}

    marked = materialize(halo_window(placed, contested, pos="pos", after=need, chunk=max(chunk, need)))
    sure = marked.where("NOT _asked")
    at = F.array_position("near", F.lit(1.0)).cast("int") - 1 if params.gate else F.lit(0)
    at = F.when(F.col("trace_x").isNull(), 0).otherwise(at)
    pick = {f: F.get(F.col(f), at) for f in CANDIDATE_FIELDS}
    taken = sure.select(
        *VIDEO, every, FRAME, *[pick[c].cast("long").alias(c) for c in BOX], pick["confidence"].alias("confidence"),
        F.when(pick["track_id"] >= 0, pick["track_id"]).alias("track_id"), pick["det_no"].alias("det_no"), F.lit(False).alias("of_synthetic"),
        F.lit(1).cast("long").alias("n_candidates"), F.lit(False).alias("conflict"), F.lit(False).alias("of_known"), F.lit(None).cast("double").alias("margin"))
    ready = marked.where("_asked").select(*VIDEO, every, "pos", FRAME, "trace_x", "trace_y", "img_w", "img_h", *CANDIDATE_FIELDS)
    out = handed_over(ready, _resolver_fold(variants), RESOLVED, keys=(*VIDEO, "variant"), order="pos", piece=piece, run_in=min(piece, RUN_IN)).unionByName(taken)
    return out.withColumns({"track_id": F.col("track_id").cast("long"), "det_no": F.col("det_no").cast("long")})


def conflict_summary(resolved: DataFrame) -> DataFrame:
    """Conflict frames, those with a known flow position, and the mean best-to-second margin (4 digits)."""
    return resolved.groupBy(*VIDEO).agg(
        F.count_if("conflict").alias("conflict_frames"), F.count_if("of_known").alias("of_available"),
        F.bround(F.avg("margin"), 4).alias("avg_margin"))


# ---------------------------------------------------------------- identity guard


def guard_identity(selected: DataFrame, trace: DataFrame | None, *, max_jump: float = 150.0, piece: int = PIECE_FRAMES) -> DataFrame:
    """Flag observations that look like an identity switch (`accepted` false).

    Without a trace: rejected when farther than `max_jump` from the last accepted one.  With a trace:
    rejected when farther than that from the trace and than half of it from the last accepted one;
    frames without a trace position are accepted unseen.  The state is the last accepted position.
    """
    s = with_box_geometry(selected).select(*VIDEO, FRAME, "cx", "cy")
    use_trace = trace is not None
    if use_trace:
        s = s.join(trace.select(*VIDEO, FRAME, "trace_x", "trace_y"), [*VIDEO, FRAME], "left")
        s = s.withColumn("of_dist", distance("cx", "cy", "trace_x", "trace_y")).drop("trace_x", "trace_y")
    else:
        s = s.withColumn("of_dist", F.lit(None).cast("double"))
    limit = max_jump * 0.5 if use_trace else max_jump

    def fold(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        last = state.get("last")
        prev_dist, accepted = [], []
        for cx, cy, of in zip(rows["cx"].tolist(), rows["cy"].tolist(), rows["of_dist"].tolist()):
            if use_trace and math.isnan(of):
                prev_dist.append(math.nan)
                accepted.append(True)
                continue
            away = math.sqrt((cx - last[0]) ** 2 + (cy - last[1]) ** 2) if last else math.nan
            far = away > limit or (use_trace and last is None)
            ok = not (far and (not use_trace or of > max_jump))
            if ok:
                last = (cx, cy)
            prev_dist.append(away)
            accepted.append(ok)
        state["last"] = last
        return rows[[*VIDEO, FRAME, "cx", "cy", "of_dist"]].assign(prev_dist=prev_dist, accepted=accepted)

    schema = "video_id long, frame_id long, cx double, cy double, of_dist double, prev_dist double, accepted boolean"
    return handed_over(s, fold, schema, piece=piece, run_in=min(piece, RUN_IN))


def guard_report(guarded: DataFrame, *, max_jump: float, with_trace: bool) -> DataFrame:
    """Rejections and distance summaries per video, in long form by kind of distance."""
    limit = max_jump * 0.5 if with_trace else max_jump
    rejected = lambda c: F.when(~F.col("accepted"), F.col(c))
    kinds = F.array(
        F.struct(F.lit("of_dist").alias("kind"), F.col("of_dist").alias("d")), F.struct(F.lit("prev_dist").alias("kind"), F.col("prev_dist").alias("d")),
        F.struct(F.lit("rejected_of_dist").alias("kind"), rejected("of_dist").alias("d")), F.struct(F.lit("rejected_prev_dist").alias("kind"), rejected("prev_dist").alias("d")))
    long = materialize(guarded.select(*VIDEO, F.inline(kinds)))
    counts = guarded.groupBy(*VIDEO).agg(
        F.count_if(~F.col("accepted")).alias("rejections"), F.count_if(F.col("of_dist") > max_jump).alias("over_max"),
        F.count_if(F.col("prev_dist") > limit).alias("over_prev"))
    return distance_summary(long, "d", (*VIDEO, "kind")).join(counts, list(VIDEO))


# ---------------------------------------------------------------- flow traces


@dataclass(frozen=True)
class TraceParams:
    mode: str = "candidates"  # or "selected"
    max_distance: float = 150.0
    interval: int = 5
    min_confidence: float = 0.0
    max_drift: float = 150.0
    single_only: bool = False
    reanchor: bool = True


def trace_seed(candidates: DataFrame, *, span: int = 50) -> DataFrame:
    """Most confident candidate of the first frames; the first listed wins.

    The search ends with the first candidate frame more than `span` frames after the first one.
    """
    first = candidates.groupBy(*VIDEO).agg(F.min(FRAME).alias("_f"))
    near = candidates.join(first, list(VIDEO))
    stop = near.where(F.col(FRAME) > F.col("_f") + span).groupBy(*VIDEO).agg(F.min(FRAME).alias("_stop"))
    pool = with_box_geometry(near.join(stop, list(VIDEO), "left").where(F.col("_stop").isNull() | (F.col(FRAME) <= F.col("_stop"))))
    best = pool.groupBy(*VIDEO).agg(F.max(F.struct("confidence", (-F.col(FRAME)).alias("f"), (-F.col("det_no")).alias("d"), "cx", "cy")).alias("b"))
    return best.select(*VIDEO, (-F.col("b.f")).alias("seed_frame"), F.col("b.cx").alias("seed_x"), F.col("b.cy").alias("seed_y"))


def _trace_fold(p: TraceParams):
    selected = p.mode == "selected"

    def fold(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        tx, ty = [], []
        fields = ("frame_id", "dx", "dy", "img_w", "img_h", "seed_frame", "seed_x", "seed_y", "cxs", "cys", "confs")
        for frame_id, dx, dy, img_w, img_h, seed_frame, seed_x, seed_y, cxs, cys, confs in zip(*[rows[c].tolist() for c in fields]):
            if cxs is not None:  # plain numbers: those of arrays cost several times as much
                cxs, cys, confs = cxs.tolist(), cys.tolist(), confs.tolist()
            if "x" not in state:  # the seed opens the series; elsewhere any candidate is a guess to begin with
                guess = frame_id != seed_frame and cxs
                state.update(x=cxs[0] if guess else seed_x, y=cys[0] if guess else seed_y, drift=0.0, since=0)
                tx.append(state["x"])
                ty.append(state["y"])
                continue
            x = max(0.0, min(state["x"] + dx, img_w - 1))
            y = max(0.0, min(state["y"] + dy, img_h - 1))
            state["drift"] += math.hypot(dx, dy)
            state["since"] += 1
            if cxs:
                due_drift = state["drift"] > p.max_drift
                hit = None
                if selected:
                    if confs[0] >= p.min_confidence:
                        state["since"] += 1  # confident frames advance the counter twice
                        if state["since"] >= p.interval or due_drift:
                            hit = (cxs[0], cys[0])
                elif not p.single_only or len(cxs) == 1:
                    best = math.inf
                    for cx, cy, conf in zip(cxs, cys, confs):
                        if p.min_confidence > 0 and conf < p.min_confidence:
                            continue
                        d = math.hypot(cx - x, cy - y)
                        if d < best:
                            best, near = d, (cx, cy)
                    if best < p.max_distance and (state["since"] >= p.interval or due_drift):
                        hit = near
                if hit:
                    x, y = hit
                    state["drift"], state["since"] = 0.0, 0
            state["x"], state["y"] = x, y
            tx.append(x)
            ty.append(y)
        return pd.DataFrame({"video_id": rows["video_id"], "frame_id": rows["frame_id"], "trace_x": tx, "trace_y": ty})

    return fold


def _clamped_shift(dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """Moving by (dx, dy) and staying inside the image: a shift, then bounds."""
    zero = F.lit(0.0)
    return F.struct(
        dx.alias("dx"), dy.alias("dy"), zero.alias("x_lo"), (width - 1).cast("double").alias("x_hi"), zero.alias("y_lo"), (height - 1).cast("double").alias("y_hi"))


def _after_another(rows: DataFrame, f: Column, g: Column) -> tuple[DataFrame, Column]:
    """Clamped shifts are closed under composition: the shifts add up, and the first bounds move like points under the second."""
    moved = lambda bound, axis: F.least(F.greatest(f[f"{axis}_{bound}"] + g[f"d{axis}"], g[f"{axis}_lo"]), g[f"{axis}_hi"])
    both = {"dx": f["dx"] + g["dx"], "dy": f["dy"] + g["dy"], **{f"{axis}_{bound}": moved(bound, axis) for axis in "xy" for bound in ("lo", "hi")}}
    return rows, F.struct(*[v.alias(k) for k, v in both.items()])


def carried_trace(rows: DataFrame, *, chunk: int = 1024) -> DataFrame:
    """Position carried from the seed along dx, dy for each (video, side), by composing clamped shifts in the JVM.

    `rows` has side, step (frames from the seed), dx, dy, img_w, img_h, seed_x, seed_y; step 0 is the seed, a map onto itself.
    """
    seed = F.struct(
        F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.col("seed_x").cast("double").alias("x_lo"), F.col("seed_x").cast("double").alias("x_hi"),
        F.col("seed_y").cast("double").alias("y_lo"), F.col("seed_y").cast("double").alias("y_hi"))
    shift = _clamped_shift(F.col("dx"), F.col("dy"), F.col("img_w"), F.col("img_h"))
    done = prefix_composed(rows, "_map", F.when(F.col("step") == 0, seed).otherwise(shift), _after_another, keys=(*VIDEO, "side"), order="step", chunk=chunk)
    return done.select(*VIDEO, FRAME, "side", "step", F.col("_map.x_lo").alias("trace_x"), F.col("_map.y_lo").alias("trace_y"))


def flow_trace(
    frames: DataFrame, flow: DataFrame, seed: DataFrame, observations: DataFrame | None = None, params: TraceParams = TraceParams(), *, piece: int = PIECE_FRAMES,
) -> DataFrame:
    """Position carried along the flow from the seed to both ends of the video.

    `frames` has every frame with img_w, img_h; `flow` has dx, dy from the previous frame and
    optionally back_dx, back_dy from the next one (the negated forward flow of the next frame
    otherwise).  Going forward the trace is re-anchored to observations, in pieces that hand their state on (after an anchor the past
    no longer counts); going backward, and forward without observations, it is a composition of clamped shifts.
    """
    back = {"back_dx", "back_dy"} <= set(flow.columns)
    cols = [*VIDEO, FRAME, "dx", "dy", *(("back_dx", "back_dy") if back else ())]
    rows = frames.select(*VIDEO, FRAME, "img_w", "img_h").join(flow.select(*cols), [*VIDEO, FRAME], "left")
    if not back:
        ahead = flow.select(*VIDEO, (F.col(FRAME) - 1).alias(FRAME), (-F.col("dx")).alias("back_dx"), (-F.col("dy")).alias("back_dy"))
        rows = rows.join(ahead, [*VIDEO, FRAME], "left")
    rows = rows.fillna(0.0, subset=["dx", "dy", "back_dx", "back_dy"]).join(seed, list(VIDEO))
    step = F.col(FRAME) - F.col("seed_frame")
    behind = rows.where(step <= 0).select(
        *VIDEO, FRAME, F.lit(-1).alias("side"), (-step).alias("step"), F.col("back_dx").alias("dx"), F.col("back_dy").alias("dy"), "img_w", "img_h", "seed_x", "seed_y")
    anchored = observations is not None and params.reanchor
    if not anchored:
        before = rows.where(step > 0).select(*VIDEO, FRAME, F.lit(1).alias("side"), step.alias("step"), "dx", "dy", "img_w", "img_h", "seed_x", "seed_y")
        opening = behind.where("step = 0").withColumn("side", F.lit(1))
        both = carried_trace(before.unionByName(opening).unionByName(behind))
        return both.where("side < 0 OR step > 0").select(*VIDEO, FRAME, "trace_x", "trace_y")
    o = with_box_geometry(observations)
    order = ["order", "det_no"] if "order" in o.columns else ["det_no"]
    per = o.groupBy(*VIDEO, FRAME).agg(F.sort_array(F.collect_list(F.struct(*order, "cx", "cy", "confidence"))).alias("_o"))
    per = per.select(*VIDEO, FRAME, F.transform("_o", _picker("cx")).alias("cxs"), F.transform("_o", _picker("cy")).alias("cys"), F.transform("_o", _picker("confidence")).alias("confs"))
    fields = [*VIDEO, FRAME, "dx", "dy", "img_w", "img_h", "seed_frame", "seed_x", "seed_y", "cxs", "cys", "confs"]
    forward = handed_over(
        rows.where(step >= 0).join(per, [*VIDEO, FRAME], "left").select(*fields), _trace_fold(params), "video_id long, frame_id long, trace_x double, trace_y double",
        piece=piece, run_in=min(piece, RUN_IN))
    return forward.unionByName(carried_trace(behind).where("step > 0").select(*VIDEO, FRAME, "trace_x", "trace_y"))


def last_single_seed(observations: DataFrame) -> DataFrame:
    """Last frame with exactly one candidate, as a seed."""
    alone = with_box_geometry(observations).groupBy(*VIDEO, FRAME).agg(F.count(F.lit(1)).alias("n"), F.first("cx").alias("x"), F.first("cy").alias("y")).where("n = 1")
    best = alone.groupBy(*VIDEO).agg(F.max(F.struct(FRAME, "x", "y")).alias("b"))
    return best.select(*VIDEO, F.col(f"b.{FRAME}").alias("seed_frame"), F.col("b.x").alias("seed_x"), F.col("b.y").alias("seed_y"))


def bidirectional_trace(frames: DataFrame, flow: DataFrame, trace: DataFrame, observations: DataFrame) -> DataFrame:
    """The trace averaged with one that starts at the last unambiguous frame and is never re-anchored."""
    pure = flow_trace(frames, flow, last_single_seed(observations), None, TraceParams(reanchor=False))
    return merge_traces(trace, pure)


# ---------------------------------------------------------------- flow gap filling


@dataclass(frozen=True)
class FlowFillParams:
    min_gap: int = 10
    drift_guard: float = 400.0
    extrapolate: int = 30


def _carry_fold(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
    """Move a box along the flow, rounded and kept inside the image at every step."""
    out = []
    for r in rows.itertuples(index=False):
        if r.gap_at != state.get("gap"):
            state.update(gap=r.gap_at, box=[r.sx1, r.sy1, r.sx2, r.sy2])
        box = state["box"]
        if not math.isnan(r.dx):
            x1, y1, x2, y2 = round(box[0] + r.dx), round(box[1] + r.dy), round(box[2] + r.dx), round(box[3] + r.dy)
            x1, y1 = max(0, min(x1, r.img_w - 1)), max(0, min(y1, r.img_h - 1))
            box = [x1, y1, max(x1 + 1, min(x2, r.img_w)), max(y1 + 1, min(y2, r.img_h))]
        state["box"] = box
        out.append((r.video_id, r.frame_id, *box, r.dx, r.dy))
    return pd.DataFrame(out, columns=["video_id", "frame_id", "x1", "y1", "x2", "y2", "dx", "dy"])


def fill_by_flow(
    track: DataFrame, videos: DataFrame, flow: DataFrame, params: FlowFillParams = FlowFillParams(), *, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """One box per frame; long gaps follow the flow from both anchors, blended by distance.

    Only the frames of long gaps leave the JVM, and every gap starts from its own anchors.  Before the
    first and after the last observation the box follows the flow for `extrapolate` frames and then
    stays.  `flow` columns as in `flow_trace`.
    """
    rows = materialize(around_gaps(track, videos, chunk=chunk).where("_a IS NOT NULL OR _b IS NOT NULL"))
    a, b, frame = F.col("_a"), F.col("_b"), F.col(FRAME)
    lead = b[FRAME] - frame
    tail = frame - a[FRAME]
    internal = a[FRAME] != b[FRAME]
    gap_len = b[FRAME] - a[FRAME] - 1
    flowing = (internal & (gap_len >= params.min_gap)) | (a.isNull() & (lead <= params.extrapolate)) | (b.isNull() & (tail <= params.extrapolate))
    steps = rows.where(flowing)
    back = {"back_dx", "back_dy"} <= set(flow.columns)
    forward_flow = flow.select(*VIDEO, FRAME, "dx", "dy")
    backward_flow = (
        flow.select(*VIDEO, FRAME, F.col("back_dx").alias("dx"), F.col("back_dy").alias("dy")) if back
        else flow.select(*VIDEO, (frame - 1).alias(FRAME), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy")))

    def carried(side: Column, direction: DataFrame, order: Column, tag: str) -> DataFrame:
        start = steps.where(side.isNotNull()).select(
            *VIDEO, FRAME, side[FRAME].alias("gap_at"), F.floor(side[FRAME] / chunk).alias("_block"), "img_w", "img_h", *[side[c].alias(f"s{c}") for c in BOX])
        moved = ordered_scan(
            start.join(direction, [*VIDEO, FRAME], "left"), _carry_fold,
            "video_id long, frame_id long, x1 long, y1 long, x2 long, y2 long, dx double, dy double",
            keys=(*VIDEO, "_block"), order=("gap_at", order))
        return moved.select(*VIDEO, FRAME, *[F.col(c).alias(f"{tag}{c}") for c in (*BOX, "dx", "dy")])

    moved = steps.join(carried(a, forward_flow, frame.asc(), "p_"), [*VIDEO, FRAME], "left")
    moved = moved.join(carried(b, backward_flow, frame.desc(), "q_"), [*VIDEO, FRAME], "left")
    t = (frame - a[FRAME]) / (b[FRAME] - a[FRAME])
    mixed = {c: F.rint((F.lit(1.0) - t) * F.col(f"p_{c}") + t * F.col(f"q_{c}")).cast("long") for c in BOX}
    blended = clamp_box(mixed["x1"], mixed["y1"], mixed["x2"], mixed["y2"], "img_w", "img_h")
    zero = F.lit(0.0)
    velocity = {
        "flow_vx": F.when(a.isNull(), F.col("q_dx")).when(b.isNull(), F.col("p_dx")).otherwise((F.lit(1.0) - t) * F.coalesce("p_dx", zero) + t * F.coalesce("q_dx", zero)),
        "flow_vy": F.when(a.isNull(), F.col("q_dy")).when(b.isNull(), F.col("p_dy")).otherwise((F.lit(1.0) - t) * F.coalesce("p_dy", zero) + t * F.coalesce("q_dy", zero))}
    moved = materialize(moved.withColumns({
        **{f"f{c}": F.when(a.isNull(), F.col(f"q_{c}")).when(b.isNull(), F.col(f"p_{c}")).otherwise(blended[c]) for c in BOX}, **velocity}))
    inner = short_gap_or_flow(moved.where(internal), min_gap=0, drift_guard=params.drift_guard)
    outer = moved.where(a.isNull() | b.isNull()).withColumn("fill", F.lit("flow")).select("*", *[F.col(f"f{c}").alias(c) for c in BOX])
    flowed = inner.select(*VIDEO, FRAME, "fill", *BOX, "flow_vx", "flow_vy").unionByName(outer.select(*VIDEO, FRAME, "fill", *BOX, "flow_vx", "flow_vy"))
    # the outermost flowed box holds for the frames beyond it
    far = moved.groupBy(*VIDEO).agg(
        F.min(F.when(a.isNull(), F.struct(FRAME, *[F.col(f"f{c}").alias(c) for c in BOX]))).alias("_head"),
        F.max(F.when(b.isNull(), F.struct(FRAME, *[F.col(f"f{c}").alias(c) for c in BOX]))).alias("_tail"))
    own = F.col("_o")
    line = linear_box(F.col("img_w"), F.col("img_h"), strict=True)
    flow_box = flowed.select(*VIDEO, FRAME, F.struct(*BOX).alias("_flow"), F.col("fill").alias("_fill"), "flow_vx", "flow_vy")
    all_rows = rows.join(flow_box, [*VIDEO, FRAME], "left").join(far, list(VIDEO), "left")
    boxes = []
    for c in BOX:
        held = F.when(a.isNull(), F.coalesce(F.col("_head")[c], b[c])).when(b.isNull(), F.coalesce(F.col("_tail")[c], a[c]))
        boxes.append(F.when(own.isNotNull(), own[c]).when(F.col("_flow").isNotNull(), F.col("_flow")[c]).when(a.isNull() | b.isNull(), held).otherwise(line[c]).alias(c))
    fill = F.when(own.isNotNull(), "none").when(F.col("_fill").isNotNull(), F.col("_fill")).when(a.isNull() | b.isNull(), "held").otherwise("line")
    return all_rows.select(
        *VIDEO, FRAME, *boxes, fill.alias("fill"), "flow_vx", "flow_vy", *[v.alias(k) for k, v in gap_columns().items()], "img_w", "img_h")


# ---------------------------------------------------------------- smoothing


def smooth_ema(
    track: DataFrame, window: int, *, keys: Sequence[str] = VIDEO, columns: tuple[str, ...] = BOX, chunk: int | None = None, rounded: bool = True,
) -> DataFrame:
    """Mean of a forward and a backward exponential average, alpha = 2 / (window + 1).

    Weights fall off geometrically, so a halo in which they drop below double precision makes the
    chunks exact.  Inside a chunk the recurrence is a running weighted sum, all in the JVM.
    """
    alpha = 2.0 / (window + 1)
    if alpha >= 1.0:
        return track
    keep = 1.0 - alpha
    halo = math.ceil(math.log(1e-18) / math.log(keep))
    longest = int(290 / math.log10(1.0 / keep)) - 2 * halo  # weights stay inside the double range
    size = max(halo, min(chunk or longest, longest))
    cut = halo_chunks(track, FRAME, before=halo, after=halo, chunk=size)
    part = Window.partitionBy(*keys, "_chunk")
    lo, hi = F.min(FRAME).over(part), F.max(FRAME).over(part)
    cut = cut.withColumns({"_i": (F.col(FRAME) - lo).cast("double"), "_j": (hi - F.col(FRAME)).cast("double")})
    out = {}
    for name in columns:
        v = F.col(name).cast("double")
        sides = []
        for step, order in (("_i", F.col(FRAME).asc()), ("_j", F.col(FRAME).desc())):
            at = F.col(step)
            # the first value counts fully, the others with alpha
            weighted = v * F.when(at == 0, 1.0).otherwise(alpha) * F.pow(F.lit(1.0 / keep), at)
            total = F.sum(weighted).over(part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
            sides.append(total * F.pow(F.lit(keep), at))
        mean = (sides[0] + sides[1]) / 2
        out[name] = F.rint(mean).cast("long") if rounded else mean
    done = cut.select(*[c for c in track.columns if c not in out], "_own", *[e.alias(n) for n, e in out.items()])
    return done.where("_own").drop("_own").select(*track.columns)


@dataclass(frozen=True)
class KalmanParams:
    window: int = 5
    r_detected: float = 4.0
    r_interpolated: float = 40.0
    reinit_gap: int = 0
    max_acceleration: float = 40.0


KALMAN_OUT = "video_id long, frame_id long, x1 long, y1 long, x2 long, y2 long, vx double, vy double"


VELOCITY_NOISE = 10.0


def _ahead(kept: tuple, p: KalmanParams) -> tuple:
    """The state and covariance predicted for the next frame."""
    x, y, size, (c00, c01, c02, c11, c12, c22, cs) = kept[:4]
    top, scale = p.max_acceleration, max(1.0, float(p.window))
    x = [x[0] + x[1] + 0.5 * x[2], x[1] + x[2], max(-top, min(top, x[2]))]
    y = [y[0] + y[1] + 0.5 * y[2], y[1] + y[2], max(-top, min(top, y[2]))]
    # rows of F P, then F P F' + Q
    a0, a1, a2 = c00 + c01 + 0.5 * c02, c01 + c11 + 0.5 * c12, c02 + c12 + 0.5 * c22
    b1, b2 = c11 + c12, c12 + c22
    return x, y, size, (a0 + a1 + 0.5 * a2 + scale, a1 + a2, a2, b1 + b2 + 4 * scale, b2, c22 + 8 * scale, cs + 0.5 * scale)


def kalman_filter(obs: np.ndarray, detected: np.ndarray, flow: np.ndarray, missing_run: np.ndarray, p: KalmanParams, before: tuple | None = None) -> list[tuple]:
    """Per frame (x, y, size, covariance, restarted), going on from the state `before`."""
    cxs, cys, ws, hs = (c.tolist() for c in obs.T)
    us, vs = (c.tolist() for c in flow.T)
    seen, gaps = np.asarray(detected).tolist(), np.asarray(missing_run).tolist()
    fresh = (5.0, 0.0, 0.0, 25.0, 0.0, 100.0, 10.0)
    kept: list[tuple] = []
    for i in range(len(obs)):
        if before is None:
            before = ([cxs[i], us[i], 0.0], [cys[i], vs[i], 0.0], [ws[i], hs[i]], fresh, True)
            kept.append(before)
            continue
        x, y, size, (c00, c01, c02, c11, c12, c22, cs) = _ahead(before, p)
        restart = p.reinit_gap > 0 and seen[i] and gaps[i] >= p.reinit_gap
        if restart:
            x, y, size = [cxs[i], us[i], 0.0], [cys[i], vs[i], 0.0], [ws[i], hs[i]]
            c00, c01, c02, c11, c12, c22, cs = fresh
        r = p.r_detected if seen[i] else p.r_interpolated
        k0, k1, k2 = c00 / (c00 + r), c01 / (c00 + r), c02 / (c00 + r)
        dx, dy = cxs[i] - x[0], cys[i] - y[0]
        x = [x[0] + k0 * dx, x[1] + k1 * dx, x[2] + k2 * dx]
        y = [y[0] + k0 * dy, y[1] + k1 * dy, y[2] + k2 * dy]
        c11, c12, c22 = c11 - k1 * c01, c12 - k1 * c02, c22 - k2 * c02
        c00, c01, c02 = c00 - k0 * c00, c01 - k0 * c01, c02 - k0 * c02
        ks = cs / (cs + (8.0 if seen[i] else 16.0))
        size = [size[0] + ks * (ws[i] - size[0]), size[1] + ks * (hs[i] - size[1])]
        cs -= ks * cs
        if abs(us[i]) > 0.01 or abs(vs[i]) > 0.01:
            s = c11 + VELOCITY_NOISE
            k0, k1, k2 = c01 / s, c11 / s, c12 / s
            dx, dy = us[i] - x[1], vs[i] - y[1]
            x = [x[0] + k0 * dx, x[1] + k1 * dx, x[2] + k2 * dx]
            y = [y[0] + k0 * dy, y[1] + k1 * dy, y[2] + k2 * dy]
            c00, c02, c22 = c00 - k0 * c01, c02 - k0 * c12, c22 - k2 * c12
            c01, c11, c12 = c01 - k0 * c11, c11 - k1 * c11, c12 - k1 * c12
        before = (x, y, size, (c00, c01, c02, c11, c12, c22, cs), bool(restart))
        kept.append(before)
    return kept


def kalman_smooth(kept: list[tuple], p: KalmanParams, after: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """Columns cx, cy, vx, vy, ax, ay, w, h of filtered frames, and what the frames before them need as `after`: the smoothed
    state (x, y, size) of the frame behind and whether the filter restarted there."""
    out = np.empty((len(kept), 8))
    for i in range(len(kept) - 1, -1, -1):
        fx, fy, fs, (c00, c01, c02, c11, c12, c22, cs), restarted = kept[i]
        if after is None or after[3]:  # never smooth across a restart
            sx, sy, ss = fx, fy, fs
        else:
            sx, sy, ss, _ = after
            px, py, ps, (m00, m01, m02, m11, m12, m22, ms) = _ahead(kept[i], p)
            # inverse of the predicted covariance, by cofactors
            i00, i01, i02 = m11 * m22 - m12 * m12, m02 * m12 - m01 * m22, m01 * m12 - m02 * m11
            i11, i12, i22 = m00 * m22 - m02 * m02, m01 * m02 - m00 * m12, m00 * m11 - m01 * m01
            det = m00 * i00 + m01 * i01 + m02 * i02
            if det:
                # rows of P F'
                rows = (
                    (c00 + c01 + 0.5 * c02, c01 + c02, c02), (c01 + c11 + 0.5 * c12, c11 + c12, c12), (c02 + c12 + 0.5 * c22, c12 + c22, c22))
                moved = []
                for f, s, q in ((fx, sx, px), (fy, sy, py)):
                    d0, d1, d2 = s[0] - q[0], s[1] - q[1], s[2] - q[2]
                    e0 = (i00 * d0 + i01 * d1 + i02 * d2) / det
                    e1 = (i01 * d0 + i11 * d1 + i12 * d2) / det
                    e2 = (i02 * d0 + i12 * d1 + i22 * d2) / det
                    moved.append([f[j] + rows[j][0] * e0 + rows[j][1] * e1 + rows[j][2] * e2 for j in range(3)])
                sx, sy = moved
                g = cs / ms
                ss = [fs[0] + g * (ss[0] - ps[0]), fs[1] + g * (ss[1] - ps[1])]
            else:
                sx, sy, ss = fx, fy, fs
        out[i] = (sx[0], sy[0], sx[1], sy[1], sx[2], sy[2], *ss)
        after = (sx, sy, ss, restarted)
    return out, after


def kalman_rts(obs: np.ndarray, detected: np.ndarray, flow: np.ndarray, missing_run: np.ndarray, p: KalmanParams) -> np.ndarray:
    """Constant-acceleration filter and backward smoother over (cx, cy, w, h).

    `flow` rows are velocity measurements where either component is above 0.01; `missing_run` is the
    number of undetected frames just before each row.  All noise is diagonal, so the eight-state filter
    falls apart into two axes of (position, velocity, acceleration) that share one 3x3 covariance and
    two sizes that share one variance.  Returns columns cx, cy, vx, vy, ax, ay, w, h.
    """
    return kalman_smooth(kalman_filter(obs, detected, flow, missing_run, p), p)[0]


STATE = [f"_k{i}" for i in range(15)]


def smooth_kalman(track: DataFrame, params: KalmanParams = KalmanParams(), *, piece: int = PIECE_FRAMES) -> DataFrame:
    """Kalman and RTS smoothing of boxes, using flow velocities where given (flow_vx, flow_vy).

    The filter clips accelerations, so its steps do not compose; forwards and backwards, pieces of a video run side by side and hand
    their state on until it agrees to the last bit, so the result is that of one pass.
    """
    rows = track.select(
        *VIDEO, FRAME, *BOX, "detected", F.coalesce("flow_vx", F.lit(0.0)).alias("flow_vx"), F.coalesce("flow_vy", F.lit(0.0)).alias("flow_vy"))
    if params.reinit_gap > 0:
        seen = running(materialize(rows), lasts={"_seen": F.when(F.col("detected"), F.col(FRAME))})
        back = running(seen, prevs={"_before": F.col("_seen")})
        first = F.lit(0).cast("long")  # the first frame never counts as missing
        rows = back.withColumn("missing_run", F.greatest(F.col(FRAME) - 1 - F.greatest(F.coalesce("_before", first), first), first)).drop("_seen", "_before")
    else:
        rows = rows.withColumn("missing_run", F.lit(0).cast("long"))

    def forwards(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        b = pdf[list(BOX)].to_numpy(float)
        obs = np.column_stack([(b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2, b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]])
        first = np.zeros(len(pdf), bool)
        first[0] = "kept" not in state
        kept = kalman_filter(obs, pdf["detected"].to_numpy(bool), pdf[["flow_vx", "flow_vy"]].to_numpy(float), pdf["missing_run"].to_numpy(), params, state.get("kept"))
        state["kept"] = kept[-1]
        out = pd.DataFrame(np.array([[*x, *y, *size, *cov] for x, y, size, cov, _ in kept]), columns=STATE)
        return pdf[["video_id", FRAME, *BOX]].reset_index(drop=True).assign(_first=first, _restarted=[k[4] for k in kept]).join(out)

    def backwards(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[::-1]  # from the first frame to the last
        alone = "after" not in state and len(pdf) == 1 and bool(pdf["_first"].iloc[0])
        kept = [(k[0:3], k[3:6], k[6:8], tuple(k[8:15]), r) for k, r in zip(pdf[STATE].to_numpy(float).tolist(), pdf["_restarted"].tolist())]
        s, state["after"] = kalman_smooth(kept, params, state.get("after"))
        w, h = np.maximum(10.0, s[:, 6]), np.maximum(10.0, s[:, 7])
        sides = np.rint(np.column_stack([s[:, 0] - w / 2, s[:, 1] - h / 2, s[:, 0] + w / 2, s[:, 1] + h / 2]))
        if alone:  # a video of one frame stays as it is
            sides, s = pdf[list(BOX)].to_numpy(float), np.zeros((1, 8))
        out = pd.DataFrame(sides.astype("int64"), columns=list(BOX))
        out.insert(0, FRAME, pdf[FRAME].to_numpy())
        out.insert(0, "video_id", pdf["video_id"].to_numpy())
        out["vx"], out["vy"] = s[:, 2], s[:, 3]
        return out

    box = ", ".join(f"{c} double" for c in BOX)
    schema = f"video_id long, {FRAME} long, {box}, _first boolean, _restarted boolean, " + ", ".join(f"{c} double" for c in STATE)
    rows = rows.withColumns({c: F.col(c).cast("double") for c in BOX})
    filtered = handed_over(rows, forwards, schema, piece=piece, run_in=min(piece, RUN_IN)).withColumn("_back", -F.col(FRAME))
    return handed_over(filtered, backwards, KALMAN_OUT, order="_back", piece=piece, run_in=min(piece, RUN_IN))


MAP = ("a11", "a12", "a21", "a22", "c11", "c12", "c22", "j11", "j12", "j22", "bx1", "bx2", "by1", "by2", "ex1", "ex2", "ey1", "ey2")


def _map(**values) -> Column:
    """A filtering element: the state after it is A state + b with covariance C; J and e say what its measurements tell of the state before."""
    return F.struct(*[(values[k] if k in values else F.lit(0.0)).cast("double").alias(k) for k in MAP])


def _filtered_after(rows: DataFrame, f: Column, g: Column) -> tuple[DataFrame, Column]:
    """Filtering elements compose associatively: with M = 1 + C J, A is A M^-1 A, b is A M^-1 (b + C e) + b, C is A M^-1 C A' + C."""
    rows = rows.withColumns({
        "_m11": F.lit(1.0) + f["c11"] * g["j11"] + f["c12"] * g["j12"], "_m12": f["c11"] * g["j12"] + f["c12"] * g["j22"],
        "_m21": f["c12"] * g["j11"] + f["c22"] * g["j12"], "_m22": F.lit(1.0) + f["c12"] * g["j12"] + f["c22"] * g["j22"]})
    m = {i: F.col(f"_m{i}") for i in ("11", "12", "21", "22")}
    rows = rows.withColumn("_det", m["11"] * m["22"] - m["12"] * m["21"])
    det = F.col("_det")
    rows = rows.withColumns({"_v11": m["22"] / det, "_v12": -m["12"] / det, "_v21": -m["21"] / det, "_v22": m["11"] / det})
    v = {i: F.col(f"_v{i}") for i in ("11", "12", "21", "22")}
    rows = rows.withColumns({
        # T = A M^-1 of the later, U = M^-1 A of the earlier element
        **{f"_t{i}{j}": g[f"a{i}1"] * v[f"1{j}"] + g[f"a{i}2"] * v[f"2{j}"] for i in "12" for j in "12"},
        **{f"_u{i}{j}": v[f"{i}1"] * f[f"a1{j}"] + v[f"{i}2"] * f[f"a2{j}"] for i in "12" for j in "12"},
        **{f"_s{axis}1": f[f"b{axis}1"] + f["c11"] * g[f"e{axis}1"] + f["c12"] * g[f"e{axis}2"] for axis in "xy"},
        **{f"_s{axis}2": f[f"b{axis}2"] + f["c12"] * g[f"e{axis}1"] + f["c22"] * g[f"e{axis}2"] for axis in "xy"},
        **{f"_r{axis}1": g[f"e{axis}1"] - g["j11"] * f[f"b{axis}1"] - g["j12"] * f[f"b{axis}2"] for axis in "xy"},
        **{f"_r{axis}2": g[f"e{axis}2"] - g["j12"] * f[f"b{axis}1"] - g["j22"] * f[f"b{axis}2"] for axis in "xy"}})
    t, u = ({f"{i}{j}": F.col(f"_{name}{i}{j}") for i in "12" for j in "12"} for name in "tu")
    rows = rows.withColumns({
        **{f"_k{i}1": t[f"{i}1"] * f["c11"] + t[f"{i}2"] * f["c12"] for i in "12"}, **{f"_k{i}2": t[f"{i}1"] * f["c12"] + t[f"{i}2"] * f["c22"] for i in "12"},
        **{f"_w{i}1": u[f"1{i}"] * g["j11"] + u[f"2{i}"] * g["j12"] for i in "12"}, **{f"_w{i}2": u[f"1{i}"] * g["j12"] + u[f"2{i}"] * g["j22"] for i in "12"}})
    k, w = ({f"{i}{j}": F.col(f"_{name}{i}{j}") for i in "12" for j in "12"} for name in "kw")
    both = {f"a{i}{j}": t[f"{i}1"] * f[f"a1{j}"] + t[f"{i}2"] * f[f"a2{j}"] for i in "12" for j in "12"}
    both |= {f"c{i}{j}": k[f"{i}1"] * g[f"a{j}1"] + k[f"{i}2"] * g[f"a{j}2"] + g[f"c{i}{j}"] for i, j in ("11", "12", "22")}
    both |= {f"j{i}{j}": w[f"{i}1"] * f[f"a1{j}"] + w[f"{i}2"] * f[f"a2{j}"] + f[f"j{i}{j}"] for i, j in ("11", "12", "22")}
    for axis in "xy":
        both |= {f"b{axis}{i}": t[f"{i}1"] * F.col(f"_s{axis}1") + t[f"{i}2"] * F.col(f"_s{axis}2") + g[f"b{axis}{i}"] for i in "12"}
        both |= {f"e{axis}{i}": u[f"1{i}"] * F.col(f"_r{axis}1") + u[f"2{i}"] * F.col(f"_r{axis}2") + f[f"e{axis}{i}"] for i in "12"}
    return rows, _map(**both)


def smooth_points(points: DataFrame, *, process_noise: float = 1.0, measurement_noise: float = 5.0, chunk: int = 256) -> DataFrame:
    """Constant-velocity Kalman filter over map positions; missing points (null) are predicted.

    Starts at the first present point of the video, also for missing rows before it.  The filter is linear, so the elements of all
    rows compose (Sarkka and Garcia-Fernandez, Temporal Parallelization of Bayesian Smoothers, 2021): a prefix composition in the JVM.
    Both axes share gains and covariances.  Rows are numbered first, for rows missing altogether are no steps.
    """
    first = points.where(F.col("venue_x").isNotNull()).groupBy(*VIDEO).agg(F.min(F.struct(FRAME, "venue_x", "venue_y")).alias("_f"))
    rows = with_position(points, "_pos").join(first, list(VIDEO)).select(*VIDEO, FRAME, "_pos", "venue_x", "venue_y", F.col("_f.venue_x").alias("_x0"), F.col("_f.venue_y").alias("_y0"))
    q, r, start = process_noise, measurement_noise, 100.0
    seen = F.col("venue_x").isNotNull()
    x, y, zero, one = F.col("venue_x"), F.col("venue_y"), F.lit(0.0), F.lit(1.0)
    s = q + r
    keeps, told = F.when(seen, r / s).otherwise(1.0), F.when(seen, 1.0 / s).otherwise(0.0)
    measured = lambda c, scale: F.when(seen, c * scale).otherwise(zero)
    step = _map(
        a11=keeps, a12=keeps, a22=one, c11=keeps * q, c22=F.lit(q), j11=told, j12=told, j22=told,
        bx1=measured(x, q / s), by1=measured(y, q / s), ex1=measured(x, 1 / s), ex2=measured(x, 1 / s), ey1=measured(y, 1 / s), ey2=measured(y, 1 / s))
    # the first row: one prediction from (x0, 0) with covariance 100, then its own measurement
    p11, p12, p22 = 2 * start + q, start, start + q
    g1, g2 = p11 / (p11 + r), p12 / (p11 + r)
    moved = lambda c, c0, gain: F.when(seen, (c - F.col(c0)) * gain).otherwise(zero)
    opening = _map(
        c11=F.when(seen, p11 - g1 * p11).otherwise(p11), c12=F.when(seen, p12 - g1 * p12).otherwise(p12), c22=F.when(seen, p22 - g2 * p12).otherwise(p22),
        bx1=F.col("_x0") + moved(x, "_x0", g1), bx2=moved(x, "_x0", g2), by1=F.col("_y0") + moved(y, "_y0", g1), by2=moved(y, "_y0", g2))
    done = prefix_composed(rows, "_map", F.when(F.col("_pos") == 0, opening).otherwise(step), _filtered_after, order="_pos", chunk=chunk)
    return done.select(*VIDEO, FRAME, F.col("_map.bx1").alias("venue_x"), F.col("_map.by1").alias("venue_y"))
