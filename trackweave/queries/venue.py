"""Queries: keyframe interpolation, calibration and map positions."""

from pyspark.sql import functions as F

from trackweave.functions import geometry as g
from trackweave.functions.geometry import r6, settled
from trackweave.operators import evaluate as ev
from trackweave.operators import interpolate as ip
from trackweave.operators import kinematics as kin
from trackweave.operators import venue as vn
from trackweave.queries.accuracy import CHUNK
from trackweave.queries.motion import centred, rounded
from trackweave.queries.registry import query

LIMITS = (1500.0, 1600.0)


# -------------------------------------------------- the spline restated for DuckDB


def _interior(x0, y0, x1, y1, x2, y2):
    d0, d1 = f"(({y1} - {y0}) / ({x1} - {x0}))", f"(({y2} - {y1}) / ({x2} - {x1}))"
    w0, w1 = f"(2 * ({x2} - {x1}) + ({x1} - {x0}))", f"(({x2} - {x1}) + 2 * ({x1} - {x0}))"
    return f"CASE WHEN {d0} * {d1} <= 0 THEN 0.0::DOUBLE ELSE ({w0} + {w1}) / ({w0} / {d0} + {w1} / {d1}) END"


def _end(x0, y0, x1, y1, x2, y2):
    h0, h1 = f"abs({x1} - {x0})", f"abs({x2} - {x1})"
    d0, d1 = f"(({y1} - {y0}) / ({x1} - {x0}))", f"(({y2} - {y1}) / ({x2} - {x1}))"
    d = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
    return (f"CASE WHEN {x2} IS NULL THEN {d0} WHEN sign({d}) <> sign({d0}) THEN 0.0::DOUBLE "
            f"WHEN sign({d0}) <> sign({d1}) AND abs({d}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {d} END")


def _hermite(x, x0, y0, m0, x1, y1, m1):
    t = f"(({x} - {x0}) / ({x1} - {x0}))"
    return (f"((2 * {t}^3 - 3 * {t}^2 + 1) * {y0} + ({t}^3 - 2 * {t}^2 + {t}) * ({x1} - {x0}) * ({m0}) "
            f"+ (3 * {t}^2 - 2 * {t}^3) * {y1} + ({t}^3 - {t}^2) * ({x1} - {x0}) * ({m1}))")


def _neighbours(src, x, reach, values=ip.VENUE):
    cols = []
    for i in range(1, reach + 1):
        for side, fn in (("p", "lag"), ("n", "lead")):
            cols.append(f"{fn}({x}::DOUBLE, {i}) OVER w AS {side}{i}x")
            cols += [f"{fn}({v}, {i}) OVER w AS {side}{i}_{v}" for v in values]
    return f"SELECT *, {', '.join(cols)} FROM {src} WINDOW w AS (PARTITION BY video_id ORDER BY {x})"


def _pt(side, v):
    return f"{side}x", f"{side}_{v}"


def _slope(x, v):
    me = (f"{x}::DOUBLE", v)
    return (f"CASE WHEN p1x IS NOT NULL AND n1x IS NOT NULL THEN {_interior(*_pt('p1', v), *me, *_pt('n1', v))} "
            f"WHEN n1x IS NOT NULL THEN {_end(*me, *_pt('n1', v), *_pt('n2', v))} WHEN p1x IS NOT NULL THEN {_end(*me, *_pt('p1', v), *_pt('p2', v))} END AS m_{v}")


def _clip(e, limit):
    return f"greatest(0.0::DOUBLE, least({e}, {limit - 1}::DOUBLE))"


def _held_out(x, v):
    inner = _hermite(x, *_pt("p1", v), f"CASE WHEN p2x IS NOT NULL THEN {_interior(*_pt('p2', v), *_pt('p1', v), *_pt('n1', v))} ELSE {_end(*_pt('p1', v), *_pt('n1', v), *_pt('n2', v))} END",
                     *_pt("n1", v), f"CASE WHEN n2x IS NOT NULL THEN {_interior(*_pt('p1', v), *_pt('n1', v), *_pt('n2', v))} ELSE {_end(*_pt('n1', v), *_pt('p1', v), *_pt('p2', v))} END")
    return f"CASE WHEN p1x IS NOT NULL AND n1x IS NOT NULL THEN {inner} END"


def _held_trend(x, v):
    def line(a, b):
        return f"CASE WHEN {b}x IS NULL THEN {a}_{v} ELSE {a}_{v} + ({x} - {a}x) / ({b}x - {a}x) * ({b}_{v} - {a}_{v}) END"
    return f"CASE WHEN p1x IS NULL THEN {line('n1', 'n2')} WHEN n1x IS NULL THEN {line('p1', 'p2')} END"


def _held_line(x, v):
    return f"CASE WHEN p1x IS NOT NULL AND n1x IS NOT NULL THEN p1_{v} + ({x} - p1x) / (n1x - p1x) * (n1_{v} - p1_{v}) END"


KEYS_SQL = f"""
nb AS ({_neighbours('gt_venue', 'frame_id', 2)}),
slopes AS (SELECT *, {_slope('frame_id', 'venue_x')}, {_slope('frame_id', 'venue_y')} FROM nb)"""


def _around(frames, keys, x, extra=("venue_x", "venue_y", "m_venue_x", "m_venue_y")):
    cols = []
    for tag, fn, w in (("a", "last_value", "pre"), ("b", "first_value", "fol")):
        for c in (x, *extra):
            cols.append(f"{fn}(CASE WHEN is_key THEN {c} END IGNORE NULLS) OVER {w} AS {tag}_{c}")
    picks = ", ".join(f"NULL AS {c}" for c in extra)
    keyed = ", ".join(extra)
    return f"""SELECT * FROM (SELECT video_id, {x}, is_key, {', '.join(cols)}
  FROM (SELECT DISTINCT video_id, {x}, false AS is_key, {picks} FROM {frames} UNION ALL SELECT video_id, {x}, true, {keyed} FROM {keys}) u
  WINDOW pre AS (PARTITION BY video_id ORDER BY {x} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), fol AS (PARTITION BY video_id ORDER BY {x} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) r WHERE NOT is_key"""


def _between(v, x):
    h = _hermite(f"{x}::DOUBLE", f"a_{x}::DOUBLE", f"a_{v}", f"a_m_{v}", f"b_{x}::DOUBLE", f"b_{v}", f"b_m_{v}")
    return f"CASE WHEN a_{x} = b_{x} THEN a_{v} ELSE {h} END"


ENDS_SQL = """ranked_keys AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS up, row_number() OVER (PARTITION BY video_id ORDER BY frame_id DESC) AS dn FROM gt_venue),
ends AS (SELECT video_id, max(frame_id) FILTER (up = 1) AS f0, max(frame_id) FILTER (up = 2) AS f1, max(frame_id) FILTER (dn = 1) AS l0, max(frame_id) FILTER (dn = 2) AS l1,
  """ + ", ".join(f"max({v}) FILTER ({k} = {i}) AS {n}{i - 1}_{v}" for v in ip.VENUE for n, k in (("f", "up"), ("l", "dn")) for i in (1, 2)) + " FROM ranked_keys GROUP BY video_id)"


def _projected(v, limit, inner):
    tr = lambda n: f"{n}0_{v} + (frame_id - {n}0)::DOUBLE / ({n}1 - {n}0) * ({n}1_{v} - {n}0_{v})"
    moved = f"CASE WHEN a_frame_id IS NULL THEN {tr('f')} WHEN b_frame_id IS NULL THEN {tr('l')} ELSE {inner} END"
    # frames are even fractions of key gaps, so values sit on rounding boundaries: nudge both sides off
    return f"round(7e-8 + CASE WHEN a_frame_id = b_frame_id THEN a_{v} WHEN f1 IS NULL THEN coalesce(a_{v}, b_{v}) ELSE {_clip(moved, limit)} END, 6) + 0.0 AS {v}"


def _projection_query(name, mode, inner):
    @query(name, "frames", "gt_venue", sql=f"""
WITH {KEYS_SQL}, ar AS ({_around('frames', 'slopes', 'frame_id')}), {ENDS_SQL}
SELECT ar.video_id, frame_id, {_projected('venue_x', LIMITS[0], inner('venue_x'))}, {_projected('venue_y', LIMITS[1], inner('venue_y'))} FROM ar JOIN ends e ON ar.video_id = e.video_id""")
    def _(frames, gt):
        out = ip.project_to_map(frames, gt, limits=LIMITS, mode=mode, chunk=CHUNK)
        return rounded(out.withColumns({v: F.col(v) + 7e-8 for v in ip.VENUE}), *ip.VENUE)


_projection_query("w15_spline_projection", "pchip", lambda v: _between(v, "frame_id"))
_projection_query("w16_linear_projection_with_trend", "linear",
                  lambda v: f"a_{v} + (frame_id - a_frame_id)::DOUBLE / (b_frame_id - a_frame_id) * (b_{v} - a_{v})")


@query("w15_spline_slopes", "gt_venue", sql=f"""
WITH {KEYS_SQL} SELECT video_id, frame_id, round(m_venue_x, 6) + 0.0 AS m_venue_x, round(m_venue_y, 6) + 0.0 AS m_venue_y FROM slopes""")
def _(gt):
    return rounded(ip.pchip_slopes(gt, chunk=CHUNK), "m_venue_x", "m_venue_y").select("video_id", "frame_id", "m_venue_x", "m_venue_y")


@query("w22_keyframe_gaps", "gt_venue", sql="""
SELECT video_id, frame_id, coalesce(frame_id - lag(frame_id) OVER w, 0) AS gap_before, coalesce(lead(frame_id) OVER w - frame_id, 0) AS gap_after FROM gt_venue WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)""")
def _(gt):
    return ip.keyframe_gaps(gt, chunk=CHUNK).select("video_id", "frame_id", "gap_before", "gap_after")


ARC_SQL = """arcs AS (SELECT video_id, frame_id, sum(d) OVER (PARTITION BY video_id ORDER BY frame_id) AS arc FROM (
  SELECT video_id, frame_id, coalesce(sqrt((cx - lag(cx) OVER w)^2 + (cy - lag(cy) OVER w)^2), 0) AS d FROM track WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)) q)"""


@query("w17_arc_length_interpolation", "frames", "gt_venue", "track", sql=f"""
WITH {ARC_SQL}, ka AS (SELECT g.*, arc FROM gt_venue g LEFT JOIN arcs a ON g.video_id = a.video_id AND g.frame_id = a.frame_id), ar AS ({_around('frames', 'ka', 'frame_id', ('venue_x', 'venue_y', 'arc'))}),
t AS (SELECT ar.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN b_arc - a_arc IS NOT NULL AND a.arc IS NOT NULL THEN CASE WHEN b_arc - a_arc > 0 THEN (a.arc - a_arc) / (b_arc - a_arc) ELSE 0.5 END
   ELSE (ar.frame_id - a_frame_id)::DOUBLE / (b_frame_id - a_frame_id) END)) AS t FROM ar LEFT JOIN arcs a ON ar.video_id = a.video_id AND ar.frame_id = a.frame_id WHERE a_frame_id IS NOT NULL AND b_frame_id IS NOT NULL)
SELECT video_id, frame_id, round(CASE WHEN a_frame_id = b_frame_id THEN a_venue_x ELSE {_clip('a_venue_x + t * (b_venue_x - a_venue_x)', LIMITS[0])} END, 6) + 0.0 AS venue_x,
  round(CASE WHEN a_frame_id = b_frame_id THEN a_venue_y ELSE {_clip('a_venue_y + t * (b_venue_y - a_venue_y)', LIMITS[1])} END, 6) + 0.0 AS venue_y FROM t""")
def _(frames, gt, track):
    arcs = kin.arc_length(track, "cx", "cy", chunk=CHUNK)
    return rounded(ip.arc_interpolation(frames, gt, arcs, limits=LIMITS, chunk=CHUNK), *ip.VENUE)


@query("w17_nearest_frame_arc", "gt_venue", "track", "frames", sql=f"""
WITH {ARC_SQL}, q AS (SELECT v.video_id, v.n_frames // 2 AS frame_id FROM videos v),
r AS (SELECT q.*, arc, row_number() OVER (PARTITION BY q.video_id ORDER BY abs(a.frame_id - q.frame_id), a.frame_id) AS rn FROM q JOIN arcs a ON q.video_id = a.video_id)
SELECT video_id, frame_id, round(arc, 4) + 0.0 AS arc FROM r WHERE rn = 1""")
def _(gt, track, frames):
    middle = frames.groupBy("video_id").agg(F.floor((F.max("frame_id") + 1) / 2).alias("frame_id"))
    out = ip.nearest_arc(middle, kin.arc_length(track, "cx", "cy", chunk=CHUNK), chunk=CHUNK)
    return out.select("video_id", "frame_id", (settled("arc", 4)).alias("arc"))


@query("p18_evenly_spaced_keyframes", "gt_venue", sql="""
WITH k AS (SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS t FROM gt_venue),
s AS (SELECT unnest([1, 2, 3, 5, 7, 10]) AS size)
SELECT video_id, frame_id, size::BIGINT AS size FROM k CROSS JOIN s
WHERE t <= size OR (size = 1 AND i = t // 2) OR (size > 1 AND list_contains(list_transform(range(size), lambda q: round_even(q * (t - 1)::DOUBLE / (size - 1), 0)::BIGINT), i))""")
def _(gt):
    return ip.evenly_spaced(gt, (1, 2, 3, 5, 7, 10), chunk=CHUNK).select("video_id", "frame_id", "size")


@query("p19_perspective_map", "track", sql="""
SELECT det_no, round((1.1 * cx + 0.02 * cy + 5) / (0.0001 * cx + 0.0002 * cy + 1), 6) + 0.0 AS map_x, round((-0.03 * cx + 0.9 * cy - 7) / (0.0001 * cx + 0.0002 * cy + 1), 6) + 0.0 AS map_y FROM track""")
def _(track):
    out = track.withColumns(g.perspective("cx", "cy", [1.1, 0.02, 5.0, -0.03, 0.9, -7.0, 0.0001, 0.0002, 1.0]))
    return rounded(out, "map_x", "map_y").select("det_no", "map_x", "map_y")


@query("p10_region_and_offset", "venue_candidates", sql="""
SELECT det_no, greatest(0, least(least(venue_x, cx), 1499)) AS rx1, greatest(0, least(least(venue_y, cy), 1599)) AS ry1,
  greatest(greatest(0, least(least(venue_x, cx), 1499)) + 1, least(greatest(venue_x, cx), 1500)) AS rx2, greatest(greatest(0, least(least(venue_y, cy), 1599)) + 1, least(greatest(venue_y, cy), 1600)) AS ry2,
  venue_x + greatest(0, least(least(venue_x, cx), 1499)) AS off_x FROM venue_candidates""")
def _(c):
    rect = c.withColumns(g.normalise_rect("venue_x", "venue_y", "cx", "cy"))
    box = g.clamp_box("rx1", "ry1", "rx2", "ry2", F.lit(1500.0), F.lit(1600.0))
    return rect.select("det_no", *[v.alias(f"r{k}") for k, v in box.items()], (F.col("venue_x") + box["x1"]).alias("off_x"))


@query("p11_match_to_venue", "venue_candidates", sql="""
SELECT det_no, round(venue_x + cx * scale, 6) + 0.0 AS athlete_vx, round(venue_y + cy * scale, 6) + 0.0 AS athlete_vy FROM venue_candidates""")
def _(c):
    out = c.withColumns(g.venue_point("venue_x", "venue_y", "cx", "cy", "scale"))
    return rounded(out, "athlete_vx", "athlete_vy").select("det_no", "athlete_vx", "athlete_vy")


@query("p12_display_rescale", "track", sql="""
SELECT det_no, round(greatest(0.0::DOUBLE, least((cx - 640) / 0.4, 1499)), 6) + 0.0 AS venue_x, round(greatest(0.0::DOUBLE, least(cy / 0.5, 1599)), 6) + 0.0 AS venue_y, round_even(cx * 0.4, 0)::BIGINT AS shown_x FROM track""")
def _(track):
    out = track.select("det_no", g.display_to_map("cx", 640, 0.4, 1500).alias("venue_x"), g.display_to_map("cy", 0, 0.5, 1600).alias("venue_y"), g.map_to_display("cx", 0.4).alias("shown_x"))
    return rounded(out, "venue_x", "venue_y")


FLOWCUM_SQL = "flowcum AS (SELECT video_id, frame_id, sum(dx) OVER w AS cum_dx, sum(dy) OVER w AS cum_dy FROM camera_flow WINDOW w AS (PARTITION BY video_id ORDER BY frame_id))"
POINTS_SQL = FLOWCUM_SQL + ", points AS (SELECT g.video_id, g.frame_id, cum_dx, cum_dy, venue_x, venue_y FROM gt_venue g JOIN flowcum f ON g.video_id = f.video_id AND g.frame_id = f.frame_id)"


def points(flow, gt):
    return gt.join(kin.cumulative_flow(flow, chunk=CHUNK).select("video_id", "frame_id", "cum_dx", "cum_dy"), ["video_id", "frame_id"])


@query("a25_linear_calibration", "camera_flow", "gt_venue", "frames", sql=f"""
WITH {POINTS_SQL} SELECT video_id, round(regr_intercept(venue_x, cum_dx), 6) + 0.0 AS x_a, round(regr_slope(venue_x, cum_dx), 6) + 0.0 AS x_b FROM points GROUP BY video_id HAVING count(*) >= 2""")
def _(flow, gt, _frames):
    return rounded(vn.linear_fit(points(flow, gt), "cum_dx", "venue_x", "x"), "x_a", "x_b").where("x_a IS NOT NULL")


@query("a26_calibration_rms", "camera_flow", "gt_venue", "frames", sql=f"""
WITH {POINTS_SQL}, f AS (SELECT video_id, regr_intercept(venue_x, cum_dx) AS a, regr_slope(venue_x, cum_dx) AS b, regr_intercept(venue_y, cum_dy) AS c, regr_slope(venue_y, cum_dy) AS d FROM points GROUP BY video_id)
SELECT p.video_id, round(sqrt(avg((a + b * cum_dx - venue_x)^2 + (c + d * cum_dy - venue_y)^2)), 6) + 0.0 AS rms FROM points p JOIN f ON p.video_id = f.video_id GROUP BY p.video_id""")
def _(flow, gt, _frames):
    p = points(flow, gt)
    fit = vn.linear_fit(p, "cum_dx", "venue_x", "x").join(vn.linear_fit(p, "cum_dy", "venue_y", "y"), "video_id")
    err = g.distance(F.col("x_a") + F.col("x_b") * F.col("cum_dx"), F.col("y_a") + F.col("y_b") * F.col("cum_dy"), "venue_x", "venue_y")
    return rounded(vn.rms(p.join(fit, "video_id").withColumn("error", err)), "rms")


AFF_SQL = """pr AS (SELECT t.video_id, cx, cy, center_x + 0.3 * cy AS u, center_y - 0.2 * cx AS v FROM track t JOIN gt_centers g ON t.video_id = g.video_id AND t.frame_id = g.frame_id),
mm AS (SELECT video_id, avg(cx) AS mx, avg(cy) AS my, avg(u) AS mu, avg(v) AS mv, count(*) AS n FROM pr GROUP BY video_id),
ss AS (SELECT p.video_id, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, sum((cx - mx)^2) AS xx, sum((cx - mx) * (cy - my)) AS xy, sum((cy - my)^2) AS yy,
   sum((cx - mx) * (u - mu)) AS xu, sum((cy - my) * (u - mu)) AS yu, sum((cx - mx) * (v - mv)) AS xv, sum((cy - my) * (v - mv)) AS yv FROM pr p JOIN mm ON p.video_id = mm.video_id GROUP BY p.video_id),
co AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy^2) AS m0, (yu * xx - xu * xy) / (xx * yy - xy^2) AS m1, (xv * yy - yv * xy) / (xx * yy - xy^2) AS m3, (yv * xx - xv * xy) / (xx * yy - xy^2) AS m4 FROM ss WHERE n >= 3),
cf AS (SELECT *, mu - m0 * mx - m1 * my AS m2, mv - m3 * mx - m4 * my AS m5 FROM co)"""


def affine_pairs(track, gt):
    return track.join(gt.drop("track_id"), ["video_id", "frame_id"]).select(
        "video_id", "cx", "cy", (F.col("center_x") + F.col("cy") * 0.3).alias("u"), (F.col("center_y") - F.col("cx") * 0.2).alias("v"))


@query("a27_affine_fit", "track", "gt_centers", sql=f"""
WITH {AFF_SQL} SELECT video_id, n, {', '.join(f'round(m{i}, 6) + 0.0 AS m{i}' for i in range(6))} FROM cf""")
def _(track, gt):
    out = vn.affine_fit(affine_pairs(track, gt), ("cx", "cy"), ("u", "v"))
    return rounded(out, *[f"m{i}" for i in range(6)]).select("video_id", "n", *[f"m{i}" for i in range(6)])


@query("a34_affine_residuals", "track", "gt_centers", sql=f"""
WITH {AFF_SQL}, r AS (SELECT p.video_id, sqrt((m0 * cx + m1 * cy + m2 - u)^2 + (m3 * cx + m4 * cy + m5 - v)^2) AS r FROM pr p JOIN cf ON p.video_id = cf.video_id)
SELECT video_id, round(avg(r), 6) + 0.0 AS mean_residual, round(max(r), 6) + 0.0 AS max_residual FROM r GROUP BY video_id""")
def _(track, gt):
    pairs = affine_pairs(track, gt)
    fit = vn.affine_fit(pairs, ("cx", "cy"), ("u", "v")).drop("n")
    return rounded(vn.affine_residuals(pairs, fit, ("cx", "cy"), ("u", "v")), "mean_residual", "max_residual")


@query("k3_best_scale", "venue_candidates", sql="""
SELECT video_id, frame_id, score, scale_idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY score DESC, scale_idx) AS rn FROM venue_candidates) q WHERE rn = 1""")
def _(c):
    return vn.best_scale(c).select("video_id", "frame_id", "score", "scale_idx")


@query("p25_dark_pixel_routing", "venue_matches", sql="""
SELECT video_id, frame_id, dark_px < 60000 AS filtered, CASE WHEN dark_px < 60000 THEN -1 ELSE score END AS score FROM venue_matches""")
def _(m):
    return vn.route_by_dark_pixels(m, 60000).select("video_id", "frame_id", "filtered", "score")


@query("p25_second_pass_union", "venue_matches", "venue_candidates", sql="""
SELECT video_id, frame_id, score, 'dark' AS match_type FROM venue_matches WHERE dark_px >= 60000
UNION ALL SELECT video_id, frame_id, score, 'sky_edge' FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY score DESC, scale_idx) AS rn FROM venue_candidates) s
WHERE rn = 1 AND score >= 0 AND EXISTS (SELECT 1 FROM venue_matches m WHERE m.video_id = s.video_id AND m.frame_id = s.frame_id AND m.dark_px < 60000)""")
def _(m, c):
    keep = ["video_id", "frame_id", "score", "dark_px"]
    return vn.second_pass(m.select(*keep), vn.best_scale(c).select(*keep), 60000).select("video_id", "frame_id", "score", "match_type")


VOTE_SQL = """votes AS (SELECT a.video_id, a.frame_id, a.score, (SELECT count(*) FROM venue_matches b WHERE b.video_id = a.video_id
   AND ((b.frame_id > a.frame_id AND a.athlete_vy <= b.athlete_vy) OR (b.frame_id < a.frame_id AND b.athlete_vy <= a.athlete_vy))) AS votes FROM venue_matches a)"""


@query("j13_consistency_votes", "venue_matches", sql=f"WITH {VOTE_SQL} SELECT video_id, frame_id, votes FROM votes")
def _(m):
    return vn.consistency_votes(m, chunk=CHUNK).select("video_id", "frame_id", "votes")


@query("a28_consistency_filter", "venue_matches", sql=f"""
WITH {VOTE_SQL}, m AS (SELECT *, max(votes) OVER (PARTITION BY video_id) AS top FROM votes) SELECT video_id, frame_id, votes FROM m WHERE top = 0 OR votes >= floor(0.9 * top)""")
def _(m):
    return vn.keep_consistent(vn.consistency_votes(m, chunk=CHUNK), 0.9).select("video_id", "frame_id", "votes")


@query("k4_anchor", "venue_matches", sql=f"""
WITH {VOTE_SQL} SELECT video_id, frame_id, votes, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY votes DESC, score DESC, frame_id) AS rn FROM votes) q WHERE rn = 1""")
def _(m):
    return vn.anchor(vn.consistency_votes(m, chunk=CHUNK)).select("video_id", "frame_id", "votes", "score")


POOL_SQL = VOTE_SQL + """,
anc AS (SELECT video_id, frame_id AS af FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY votes DESC, score DESC, frame_id) AS rn FROM votes) q WHERE rn = 1),
sky AS (SELECT video_id, frame_id, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_id) AS rn FROM venue_candidates) q WHERE rn = 1),
pool AS (SELECT m.video_id, m.frame_id, m.score, m.frame_id = af AS is_anchor, false AS is_sky FROM venue_matches m JOIN anc ON m.video_id = anc.video_id WHERE dark_px >= 240000 OR m.frame_id = af
  UNION ALL SELECT video_id, frame_id, score, false, true FROM sky)"""


def pool(m, c):
    anchors = vn.anchor(vn.consistency_votes(m, chunk=CHUNK))
    sky = vn.best_by_score(c.select("video_id", "frame_id", "score", "dark_px"))
    return vn.calibration_pool(m.select("video_id", "frame_id", "score", "dark_px"), anchors, sky, min_dark=60000)


@query("k6_calibration_pool", "venue_matches", "venue_candidates", sql=f"WITH {POOL_SQL} SELECT * FROM pool")
def _(m, c):
    return pool(m, c).select("video_id", "frame_id", "score", "is_anchor", "is_sky")


@query("k5_top_with_forced", "venue_matches", "venue_candidates", sql=f"""
WITH {POOL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, is_sky, frame_id) AS rn FROM pool),
best AS (SELECT video_id, frame_id FROM r WHERE rn <= 20),
miss AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY score DESC, is_sky) AS k FROM r WHERE (is_anchor OR is_sky) AND NOT EXISTS (SELECT 1 FROM best WHERE best.video_id = r.video_id AND best.frame_id = r.frame_id)),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY is_sky DESC) AS pick FROM miss WHERE k = 1) q
  WHERE pick = 1 AND video_id NOT IN (SELECT r.video_id FROM r JOIN sky ON r.video_id = sky.video_id AND r.frame_id = sky.frame_id WHERE rn = 20))
SELECT video_id, frame_id, score, is_anchor, is_sky FROM r WHERE rn < 20 OR (rn = 20 AND video_id NOT IN (SELECT video_id FROM last))
UNION ALL SELECT video_id, frame_id, score, is_anchor, is_sky FROM last""")
def _(m, c):
    return vn.top_with_forced(pool(m, c), 20).select("video_id", "frame_id", "score", "is_anchor", "is_sky")


PRED_SQL = POINTS_SQL + f""",
nb AS ({_neighbours('points', 'cum_dy', 2)}),
slopes AS (SELECT *, {_slope('cum_dy', 'venue_x')}, {_slope('cum_dy', 'venue_y')} FROM nb),
fit AS (SELECT video_id, count(*) >= 3 AND count(DISTINCT cum_dy) = count(*) AS ok, min(cum_dy) AS lo, max(cum_dy) AS hi, regr_intercept(venue_x, cum_dx) AS xa, regr_slope(venue_x, cum_dx) AS xb,
   regr_intercept(venue_y, cum_dy) AS ya, regr_slope(venue_y, cum_dy) AS yb FROM points GROUP BY video_id),
ar AS ({_around('flowcum', '(SELECT * FROM slopes WHERE video_id IN (SELECT video_id FROM fit WHERE ok)) sl', 'cum_dy')}),
sp AS (SELECT video_id, cum_dy, {_between('venue_x', 'cum_dy')} AS sx, {_between('venue_y', 'cum_dy')} AS sy FROM ar WHERE a_cum_dy IS NOT NULL AND b_cum_dy IS NOT NULL),
pred AS (SELECT f.video_id, f.frame_id, {_clip('coalesce(CASE WHEN ok AND f.cum_dy BETWEEN lo AND hi THEN sx END, xa + xb * f.cum_dx)', LIMITS[0])} AS venue_x,
   {_clip('coalesce(CASE WHEN ok AND f.cum_dy BETWEEN lo AND hi THEN sy END, ya + yb * f.cum_dy)', LIMITS[1])} AS venue_y
  FROM flowcum f JOIN fit ON f.video_id = fit.video_id LEFT JOIN sp ON f.video_id = sp.video_id AND f.cum_dy = sp.cum_dy)"""


@query("w18_flow_calibrated_position", "camera_flow", "gt_venue", sql=f"""
WITH {PRED_SQL} SELECT video_id, frame_id, round(venue_x, 6) + 0.0 AS venue_x, round(venue_y, 6) + 0.0 AS venue_y FROM pred""")
def _(flow, gt):
    cum = kin.cumulative_flow(flow, chunk=CHUNK)
    return rounded(vn.predict(cum, points(flow, gt), limits=LIMITS), *ip.VENUE)


def _shifted(gt):
    return gt.withColumns({"venue_x": F.col("venue_x") + F.col("frame_id") % 40, "venue_y": F.col("venue_y") - F.col("frame_id") % 30})


@query("m6_calibration_evaluation", "camera_flow", "gt_venue", sql=f"""
WITH {PRED_SQL}, e AS (SELECT p.video_id, sqrt((p.venue_x - g.venue_x - g.frame_id % 40)^2 + (p.venue_y - g.venue_y + g.frame_id % 30)^2) AS error FROM pred p JOIN gt_venue g ON p.video_id = g.video_id AND p.frame_id = g.frame_id)
SELECT video_id, count(*) AS n_frames, round(avg(error), 6) + 0.0 AS mean, round(quantile_cont(error, 0.5), 6) + 0.0 AS median, round(quantile_cont(error, 0.9), 6) + 0.0 AS p90,
  round(avg(CASE WHEN error <= 50 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS within, round(sqrt(avg(error^2)), 6) + 0.0 AS rms FROM e GROUP BY video_id""")
def _(flow, gt):
    # truth moved away from the calibration points, which the spline would otherwise hit exactly
    pred = vn.predict(kin.cumulative_flow(flow, chunk=CHUNK), points(flow, gt), limits=LIMITS)
    return rounded(vn.evaluate_positions(pred, _shifted(gt)), "mean", "median", "p90", "within", "rms")


LOO_SQL = f"""nb AS ({_neighbours('gt_venue', 'frame_id', 2)}),
loo AS (SELECT video_id, frame_id, coalesce(frame_id - p1x, 0)::BIGINT AS gap_before, coalesce(n1x - frame_id, 0)::BIGINT AS gap_after, """ + ", ".join(
    f"sqrt(({_clip(f'coalesce({fn('frame_id', 'venue_x')}, {_held_trend('frame_id', 'venue_x')})', LIMITS[0])} - venue_x)^2 + ({_clip(f'coalesce({fn('frame_id', 'venue_y')}, {_held_trend('frame_id', 'venue_y')})', LIMITS[1])} - venue_y)^2) AS err_{name}"
    for name, fn in (("linear", _held_line), ("pchip", _held_out))) + " FROM nb WHERE p1x IS NOT NULL OR n1x IS NOT NULL)"


def loo(gt):
    return ip.loo_by_frame(gt, limits=LIMITS, chunk=CHUNK).where("err_linear IS NOT NULL")


@query("m5_leave_one_out_by_frame", "gt_venue", sql=f"""
WITH {LOO_SQL} SELECT video_id, frame_id, gap_before, gap_after, round(err_linear, 6) + 0.0 AS err_linear, round(err_pchip, 6) + 0.0 AS err_pchip FROM loo""")
def _(gt):
    return rounded(loo(gt), "err_linear", "err_pchip")


@query("m5_leave_one_out_summary", "gt_venue", sql=f"""
WITH {LOO_SQL}, l AS (SELECT video_id, 'err_linear' AS method, err_linear AS e FROM loo UNION ALL SELECT video_id, 'err_pchip', err_pchip FROM loo)
SELECT video_id, method, count(*) AS n, round(avg(e), 6) + 0.0 AS mean, round(quantile_cont(e, 0.5), 6) + 0.0 AS median, round(quantile_cont(e, 0.9), 6) + 0.0 AS p90, round(max(e), 6) + 0.0 AS max,
  round(avg(CASE WHEN e <= 50 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS within FROM l GROUP BY ALL""")
def _(gt):
    return rounded(ip.loo_summary(loo(gt), ("err_linear", "err_pchip")), "mean", "median", "p90", "max", "within")


@query("k8_method_winners", "gt_venue", sql=f"""
WITH {LOO_SQL}, w AS (SELECT *, CASE WHEN err_pchip < err_linear - 1 THEN 'err_pchip' WHEN err_linear < err_pchip - 1 THEN 'err_linear' ELSE 'tie' END AS winner, CASE WHEN err_linear <= err_pchip THEN 'err_linear' ELSE 'err_pchip' END AS best FROM loo)
SELECT winner, best, count(*) AS n FROM w GROUP BY ALL""")
def _(gt):
    scored = ip.best_method(ip.method_winners(loo(gt), "err_linear", "err_pchip"), ("err_linear", "err_pchip"))
    return scored.groupBy("winner", "best").agg(F.count(F.lit(1)).alias("n"))


def _held_arc(v):
    """Along the path between the neighbours; by frames where the path is not known."""
    by_path = "CASE WHEN n1_arc - p1_arc > 0 THEN (arc - p1_arc) / (n1_arc - p1_arc) WHEN n1_arc - p1_arc <= 0 AND arc IS NOT NULL THEN 0.5 END"
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce({by_path}, (frame_id - p1x) / (n1x - p1x))))"
    return f"CASE WHEN p1x IS NOT NULL AND n1x IS NOT NULL THEN p1_{v} + {t} * (n1_{v} - p1_{v}) END"


ARC_SQL = f"""path AS (SELECT video_id, frame_id, sum(d) OVER (PARTITION BY video_id ORDER BY frame_id) AS arc FROM (
  SELECT video_id, frame_id, coalesce(sqrt((cx - lag(cx) OVER w)^2 + (cy - lag(cy) OVER w)^2), 0) AS d FROM track WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)) s),
keyed AS (SELECT g.*, arc FROM gt_venue g LEFT JOIN path p ON p.video_id = g.video_id AND p.frame_id = g.frame_id),
nb AS ({_neighbours('keyed', 'frame_id', 2, (*ip.VENUE, 'arc'))})"""


@query("m5_leave_one_out_by_arc", "gt_venue", "track", sql=f"""
WITH {ARC_SQL} SELECT video_id, frame_id, coalesce(frame_id - p1x, 0)::BIGINT AS gap_before, coalesce(n1x - frame_id, 0)::BIGINT AS gap_after, """ + ", ".join(
    f"round(sqrt(({_clip(f'coalesce({one}, {_held_trend('frame_id', 'venue_x')})', LIMITS[0])} - venue_x)^2 + ({_clip(f'coalesce({two}, {_held_trend('frame_id', 'venue_y')})', LIMITS[1])} - venue_y)^2), 6) + 0.0 AS err_{name}"
    for name, one, two in (("linear", _held_line("frame_id", "venue_x"), _held_line("frame_id", "venue_y")), ("pchip", _held_out("frame_id", "venue_x"), _held_out("frame_id", "venue_y")), ("arc", _held_arc("venue_x"), _held_arc("venue_y"))))
    + " FROM nb WHERE p1x IS NOT NULL OR n1x IS NOT NULL")
def _(gt, track):
    out = ip.loo_by_frame(gt, limits=LIMITS, arcs=kin.arc_length(track, "cx", "cy", chunk=CHUNK), chunk=CHUNK).where("err_linear IS NOT NULL")
    return rounded(out, "err_linear", "err_pchip", "err_arc")


def _held_beyond(x, v):
    """The outermost cubic piece of the others continued."""
    def piece(a, b, c):
        pa, pb, pc = _pt(a, v), _pt(b, v), _pt(c, v)
        inner = f"CASE WHEN {c}x IS NOT NULL THEN {_interior(*pa, *pb, *pc)} ELSE {_end(*pb, *pa, 'NULL::DOUBLE', 'NULL::DOUBLE')} END"
        return _hermite(x, *pa, _end(*pa, *pb, *pc), *pb, inner)

    return f"CASE WHEN p1x IS NULL THEN {piece('n1', 'n2', 'n3')} WHEN n1x IS NULL THEN {piece('p1', 'p2', 'p3')} END"


FLOO_SQL = POINTS_SQL + f""",
folds AS (SELECT h.video_id, h.frame_id AS held, p.* EXCLUDE (video_id) FROM points h JOIN points p ON h.video_id = p.video_id AND h.frame_id <> p.frame_id),
ff AS (SELECT video_id, held, count(*) AS n, count(DISTINCT cum_dy) AS nd, regr_intercept(venue_x, cum_dx) AS xa, regr_slope(venue_x, cum_dx) AS xb, regr_intercept(venue_y, cum_dy) AS ya, regr_slope(venue_y, cum_dy) AS yb
  FROM folds GROUP BY video_id, held),
nb AS ({_neighbours('points', 'cum_dy', 3)}),
first_key AS (SELECT video_id, min(frame_id) AS first_frame FROM points GROUP BY video_id),
curves AS (SELECT video_id, frame_id, coalesce({_held_out('cum_dy', 'venue_x')}, {_held_beyond('cum_dy', 'venue_x')}) AS sx, coalesce({_held_out('cum_dy', 'venue_y')}, {_held_beyond('cum_dy', 'venue_y')}) AS sy FROM nb),
pred AS (SELECT p.*, CASE WHEN n >= 3 AND nd = n THEN sx WHEN n >= 2 THEN xa + xb * cum_dx END AS px, CASE WHEN n >= 3 AND nd = n THEN sy WHEN n >= 2 THEN ya + yb * cum_dy END AS py
  FROM points p LEFT JOIN ff ON ff.video_id = p.video_id AND ff.held = p.frame_id JOIN curves c ON c.video_id = p.video_id AND c.frame_id = p.frame_id JOIN first_key k ON k.video_id = p.video_id WHERE p.frame_id <> first_frame)"""


@query("m5_leave_one_out_by_flow", "camera_flow", "gt_venue", sql=f"""
WITH {FLOO_SQL} SELECT video_id, frame_id, round(CASE WHEN px IS NOT NULL AND py IS NOT NULL THEN sqrt(({_clip('px', LIMITS[0])} - venue_x)^2 + ({_clip('py', LIMITS[1])} - venue_y)^2) END, 5) + 0.0 AS error FROM pred""")
def _(flow, gt):
    # cubic pieces continued far beyond their ends lose digits, so five are compared
    return vn.loo_by_flow(points(flow, gt), limits=LIMITS, fixed_anchor=True).withColumn("error", settled("error", 5))


@query("m7_sparsity_study", "frames", "gt_venue", sql=f"""
WITH k AS (SELECT video_id, frame_id, venue_x, venue_y, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS t FROM gt_venue),
s AS (SELECT unnest([0, 1, 2, 3, 5, 7, 10]) AS size),
kept AS (SELECT k.*, size FROM k CROSS JOIN s WHERE size = 0 OR t <= size OR (size = 1 AND i = t // 2)
   OR (size > 1 AND list_contains(list_transform(range(size), lambda q: round_even(q * (t - 1)::DOUBLE / (size - 1), 0)::BIGINT), i))),
fs AS (SELECT f.video_id, f.frame_id, size FROM frames f CROSS JOIN s),
a AS (SELECT fs.*, k.frame_id AS ka, k.venue_x AS xa, k.venue_y AS ya FROM fs ASOF LEFT JOIN kept k ON fs.video_id = k.video_id AND fs.size = k.size AND fs.frame_id >= k.frame_id),
b AS (SELECT a.*, k.frame_id AS kb, k.venue_x AS xb, k.venue_y AS yb FROM a ASOF LEFT JOIN kept k ON a.video_id = k.video_id AND a.size = k.size AND a.frame_id <= k.frame_id),
p AS (SELECT video_id, frame_id, size, ka, kb, CASE WHEN ka IS NULL THEN xb WHEN kb IS NULL OR ka = kb THEN xa ELSE xa + (frame_id - ka)::DOUBLE / (kb - ka) * (xb - xa) END AS x,
   CASE WHEN ka IS NULL THEN yb WHEN kb IS NULL OR ka = kb THEN ya ELSE ya + (frame_id - ka)::DOUBLE / (kb - ka) * (yb - ya) END AS y FROM b),
e AS (SELECT p.video_id, p.size, sqrt((p.x - q.x)^2 + (p.y - q.y)^2) AS e FROM p JOIN p q ON p.video_id = q.video_id AND p.frame_id = q.frame_id AND q.size = 0 AND q.ka IS NOT NULL AND q.kb IS NOT NULL)
SELECT video_id, size::BIGINT AS size, count(*) AS n, round(avg(e), 6) + 0.0 AS mean, round(quantile_cont(e, 0.5), 6) + 0.0 AS median, round(quantile_cont(e, 0.9), 6) + 0.0 AS p90, round(max(e), 6) + 0.0 AS max,
  round(avg(CASE WHEN e <= 50 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS within FROM e GROUP BY ALL""")
def _(frames, gt):
    return rounded(ip.sparsity_study(frames, gt, chunk=CHUNK), "mean", "median", "p90", "max", "within")


@query("m9_calibration_from_matches", "venue_matches", "venue_candidates", "camera_flow")
def _(m, c, flow):
    best = vn.best_scale(c).withColumns(g.venue_point("venue_x", "venue_y", "cx", "cy", "scale"))
    sky = best.where(F.col("dark_px") < 60000).select("video_id", "frame_id", "scale_idx", "score", "dark_px", "athlete_vx", "athlete_vy")
    return vn.calibrate_from_matches(m, sky, kin.cumulative_flow(flow, chunk=CHUNK), min_dark=60000, limits=LIMITS, chunk=CHUNK)
