"""Queries: pose conversion, angles, features and projections."""

from pyspark.sql import functions as F

from trackweave.functions import pose as px
from trackweave.functions.geometry import r6
from trackweave.functions.skeleton import ANGLES, COCO_17, COCO_BONES, H36M_17, MIRROR_PAIRS
from trackweave.operators import gapfill as gf
from trackweave.operators import pose as ps
from trackweave.operators.series import with_position
from trackweave.queries.motion import rounded
from trackweave.queries.registry import query

POSE_CHUNK = 64

# one row per frame with the joints as lists, for DuckDB (1-based lists)
WIDE_SQL = """wide AS (SELECT video_id, frame_id, list(x ORDER BY joint) AS xs, list(y ORDER BY joint) AS ys, list(z ORDER BY joint) AS zs, list(conf ORDER BY joint) AS cs FROM pose_points GROUP BY ALL)"""


def names(ref):
    return F.array(*[F.lit(n) for n in ref])


def joints(poses, column):
    """Long form of an array of joint structs for comparison."""
    return poses.select("video_id", "frame_id", F.posexplode(column).alias("joint", "p")).select("video_id", "frame_id", "joint", "p.*")


def _mid(a, b, c="xs"):
    return f"({c}[{a + 1}] + {c}[{b + 1}]) / 2"


def _h36m_sql():
    rows = []
    for j, name in enumerate(H36M_17):
        if name == "pelvis":
            e = (_mid(11, 12), _mid(11, 12, "ys"), "least(cs[12], cs[13])")
        elif name in ("thorax", "neck"):
            e = (_mid(5, 6), _mid(5, 6, "ys"), "least(cs[6], cs[7])")
        elif name == "spine":
            e = tuple(f"(({_mid(11, 12, c)}) + ({_mid(5, 6, c)})) / 2" for c in ("xs", "ys")) + ("least(cs[12], cs[13], cs[6], cs[7])",)
        elif name == "head":
            w = "(cs[1] + cs[2] + cs[3] + cs[4] + cs[5])"
            e = tuple(f"CASE WHEN {w} > 0 THEN ({' + '.join(f'{c}[{i}] * cs[{i}]' for i in range(1, 6))}) / greatest({w}, 1e-6) ELSE {_mid(5, 6, c)} END" for c in ("xs", "ys"))
            e += (f"CASE WHEN {w} > 0 THEN greatest(cs[1], cs[2], cs[3], cs[4], cs[5]) ELSE least(cs[6], cs[7]) END",)
        else:
            k = COCO_17.index(name) + 1
            e = (f"xs[{k}]", f"ys[{k}]", f"cs[{k}]")
        rows.append(f"SELECT video_id, frame_id, {j} AS joint, {e[0]} AS x, {e[1]} AS y, {e[2]} AS conf FROM wide")
    return " UNION ALL ".join(rows)


ROUND3 = "round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y"


@query("h1_coco_to_h36m", "poses", sql=f"WITH {WIDE_SQL}, h AS ({_h36m_sql()}) SELECT video_id, frame_id, joint::INT AS joint, {ROUND3}, round(conf, 6) + 0.0 AS conf FROM h")
def _(poses):
    out = poses.withColumn("h", px.to_h36m("kp", names(COCO_17)))
    return rounded(joints(out, "h"), "x", "y", "conf")


@query("h1_h36m_unchanged", "poses", sql="SELECT video_id, frame_id, joint, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(conf, 6) + 0.0 AS conf FROM pose_points")
def _(poses):
    return rounded(joints(poses.withColumn("h", px.to_h36m("kp", names(H36M_17))), "h"), "x", "y", "conf")


for _name, _part in (("h2_midpoint", 0), ("h3_head_point", 10)):
    @query(_name, "poses", sql=f"WITH {WIDE_SQL}, h AS ({_h36m_sql()}) SELECT video_id, frame_id, {ROUND3}, round(conf, 6) + 0.0 AS conf FROM h WHERE joint = {_part}")
    def _(poses, part=_part):
        kp = F.col("kp")
        mid = px.midpoint(kp[11], kp[12]) if part == 0 else px.head_point(kp, px.midpoint(kp[5], kp[6]))
        return rounded(poses.select("video_id", "frame_id", mid.alias("p")).select("video_id", "frame_id", "p.*"), "x", "y", "conf")


def _norm_sql(left, right):
    ox, oy = f"(xs[{left + 1}] + xs[{right + 1}]) / 2", f"(ys[{left + 1}] + ys[{right + 1}]) / 2"
    return f"""o AS (SELECT *, {ox} AS ox, {oy} AS oy FROM wide),
sc AS (SELECT o.video_id, o.frame_id, ox, oy, max(greatest(abs(x - ox), abs(y - oy))) + 1e-6 AS ext FROM o JOIN pose_points p ON o.video_id = p.video_id AND o.frame_id = p.frame_id GROUP BY ALL),
nrm AS (SELECT p.video_id, p.frame_id, joint, (x - ox) / ext AS x, (y - oy) / ext AS y, conf FROM pose_points p JOIN sc ON p.video_id = sc.video_id AND p.frame_id = sc.frame_id)"""


def normalised(poses):
    n = names(H36M_17)
    return poses.withColumn("n", px.centred_and_scaled("kp", px.hip_index(n, "left"), px.hip_index(n, "right")))


@query("h4_h12_hip_centred_scaled", "poses", sql=f"WITH {WIDE_SQL}, {_norm_sql(4, 1)} SELECT video_id, frame_id, joint, {ROUND3} FROM nrm")
def _(poses):
    return rounded(joints(normalised(poses), "n"), "x", "y").drop("conf")


@query("h5_naive_lift", "poses", sql=f"WITH {WIDE_SQL}, {_norm_sql(4, 1)} SELECT video_id, frame_id, joint, {ROUND3}, round(-0.3 * y, 6) + 0.0 AS z FROM nrm")
def _(poses):
    return rounded(joints(normalised(poses).withColumn("l", px.naive_lift("n")), "l"), "x", "y", "z")


_SWAP = " ".join(f"WHEN {a} THEN {b}" for p in MIRROR_PAIRS for a, b in (p, p[::-1]))


@query("h6_mirror", "poses", sql=f"SELECT video_id, frame_id, CASE joint {_SWAP} ELSE joint END::INT AS joint, round(-x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM pose_points")
def _(poses):
    return rounded(joints(poses.withColumn("m", px.mirrored("pose")), "m"), "x", "y", "z")


@query("h7_augmentation", "poses")
def _(poses):
    return joints(ps.augmented(poses, noise=0.005, seed=7), "pose")


@query("h8_padded_training_sample", "poses", sql="""
WITH r AS (SELECT DISTINCT video_id, frame_id FROM pose_points), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM r)
SELECT video_id, frame_id, pos AS slot FROM k UNION ALL SELECT video_id, frame_id, unnest(range(n, (SELECT max(n) FROM k))) AS slot FROM k WHERE pos = n - 1""")
def _(poses):
    # as long as the longest video, so no random crop takes part
    longest = poses.groupBy("video_id").count().agg(F.max("count")).first()[0] or 1
    return ps.fixed_length(poses, longest, chunk=POSE_CHUNK).select("video_id", "frame_id", "slot")


@query("h8_cropped_training_sample", "poses")
def _(poses):
    return ps.fixed_length(poses, 32, seed=3, chunk=POSE_CHUNK).select("video_id", "frame_id", "slot")


@query("h9_channel_major", "poses", sql=f"""
WITH {WIDE_SQL}, c AS (SELECT video_id, frame_id, 0 AS channel, xs AS v FROM wide UNION ALL SELECT video_id, frame_id, 1, ys FROM wide UNION ALL SELECT video_id, frame_id, 2, zs FROM wide)
SELECT video_id, frame_id, channel, round(list_sum(v), 6) + 0.0 AS total, round(v[5], 6) + 0.0 AS fifth FROM c""")
def _(poses):
    c = ps.channel_rows(ps.long_to_nested(ps.nested_to_long(poses)))
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return c.select("video_id", "frame_id", "channel", r6(total).alias("total"), r6(F.col("values")[4]).alias("fifth"))


def _v(a, b):
    return [f"({c}[{a + 1}] - {c}[{b + 1}])" for c in ("xs", "ys", "zs")]


def _angle_sql(a, b, c):
    u, v = _v(a, b), _v(c, b)
    n = lambda w: f"greatest(sqrt({w[0]}^2 + {w[1]}^2 + {w[2]}^2), 1e-8)"
    dot = " + ".join(f"{i} / {n(u)} * ({j} / {n(v)})" for i, j in zip(u, v))
    return f"acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {dot})))"


HEIGHT_SQL = "sqrt(" + " + ".join(f"({c}[11] - ({c}[4] + {c}[7]) / 2)^2" for c in ("xs", "ys", "zs")) + ")"
SIGNAL_SQL = WIDE_SQL + ", sig AS (" + " UNION ALL ".join(
    f"SELECT video_id, frame_id, {i} AS sig, {_angle_sql(*t)} AS v FROM wide" for i, t in enumerate(ANGLES)) + """
 UNION ALL SELECT video_id, frame_id, 12 + joint, d FROM (SELECT video_id, frame_id, joint, sqrt((x - lag(x) OVER w)^2 + (y - lag(y) OVER w)^2 + (z - lag(z) OVER w)^2) AS d FROM pose_points WINDOW w AS (PARTITION BY video_id, joint ORDER BY frame_id)) s WHERE d IS NOT NULL
 UNION ALL SELECT video_id, frame_id, 29, """ + HEIGHT_SQL + " FROM wide)"


@query("h10_joint_angles", "poses", sql=f"WITH {SIGNAL_SQL} SELECT video_id, frame_id, sig::INT AS angle, round(v, 6) + 0.0 AS value FROM sig WHERE sig < 12")
def _(poses):
    out = poses.select("video_id", "frame_id", F.posexplode(px.joint_angles("pose")).alias("angle", "value"))
    return rounded(out, "value")


@query("h11_body_height", "poses", sql=f"WITH {WIDE_SQL} SELECT video_id, frame_id, round({HEIGHT_SQL}, 6) + 0.0 AS height FROM wide")
def _(poses):
    return poses.select("video_id", "frame_id", r6(px.body_height("pose")).alias("height"))


@query("w23_pose_speed", "poses", sql=f"WITH {SIGNAL_SQL} SELECT video_id, frame_id, (sig - 12)::INT AS joint, round(v, 6) + 0.0 AS speed FROM sig WHERE sig BETWEEN 12 AND 28")
def _(poses):
    s = ps.pose_speeds(poses.select("video_id", "frame_id", "pose"), chunk=POSE_CHUNK)
    return rounded(s.select("video_id", "frame_id", F.posexplode("speeds").alias("joint", "speed")), "speed")


STATS_SQL = SIGNAL_SQL + """, mom AS (SELECT video_id, sig, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS mn, max(v) AS mx FROM sig GROUP BY ALL),
sk AS (SELECT m.video_id, m.sig, CASE WHEN any_value(n) < 3 OR any_value(std) < 1e-10 THEN 0 ELSE avg((v - mean)^3) / any_value(std)^3 END AS skew FROM sig s JOIN mom m ON s.video_id = m.video_id AND s.sig = m.sig GROUP BY ALL),
st AS (SELECT mom.*, mx - mn AS rng, skew FROM mom JOIN sk ON mom.video_id = sk.video_id AND mom.sig = sk.sig),
feat AS (SELECT video_id, sig * 6 + k AS idx, CASE k WHEN 0 THEN mean WHEN 1 THEN std WHEN 2 THEN mn WHEN 3 THEN mx WHEN 4 THEN rng ELSE skew END AS value FROM st CROSS JOIN range(6) r(k) WHERE sig < 12
 UNION ALL SELECT video_id, 72 + (sig - 12) * 4 + k, CASE k WHEN 0 THEN mean WHEN 1 THEN std WHEN 2 THEN mx ELSE rng END FROM st CROSS JOIN range(4) r(k) WHERE sig >= 12)"""


@query("a22_pose_features", "poses", sql=f"WITH {STATS_SQL} SELECT video_id, idx::INT AS idx, round(value, 6) + 0.0 AS value FROM feat")
def features(poses):
    f = ps.pose_features(poses.select("video_id", "frame_id", "pose"), chunk=POSE_CHUNK)
    return rounded(f.select("video_id", F.posexplode("features").alias("idx", "value")), "value")


@query("a21_temporal_stats", "poses", sql=f"WITH {STATS_SQL} SELECT video_id, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(mn, 6) + 0.0 AS min, round(mx, 6) + 0.0 AS max, round(rng, 6) + 0.0 AS range, round(skew, 6) + 0.0 AS skew FROM st WHERE sig = 29")
def _(poses):
    h = poses.select("video_id", px.body_height("pose").alias("h"))
    out = h.groupBy("video_id").agg(*[c.alias(n) for n, c in zip(ps.ANGLE_STATS, ps.stats(F.col("h"), ps.ANGLE_STATS))])
    return rounded(out, *ps.ANGLE_STATS)


@query("a30_axis_extent", "poses", sql="SELECT video_id, round(max(greatest(abs(x), abs(y), abs(z))), 6) + 0.0 AS extent FROM pose_points GROUP BY video_id")
def _(poses):
    return rounded(ps.axis_extent(poses), "extent")


_BONE_SQL = ", ".join(f"({a}, {b})" for a, b in COCO_BONES)


@query("j15_visible_bones", "poses", sql=f"""
SELECT a.video_id, a.frame_id, e.parent, e.child, round(a.x, 6) + 0.0 AS x1, round(b.y, 6) + 0.0 AS y2 FROM (VALUES {_BONE_SQL}) e(parent, child)
JOIN pose_points a ON a.joint = e.parent AND a.conf > 0.15 JOIN pose_points b ON b.joint = e.child AND b.conf > 0.15 AND a.video_id = b.video_id AND a.frame_id = b.frame_id""")
def _(poses):
    out = poses.select("video_id", "frame_id", F.inline(px.visible_bones("kp", threshold=0.15)))
    return rounded(out, "x1", "y2").select("video_id", "frame_id", "parent", "child", "x1", "y2")


@query("h14_panel_projection", "poses", sql=f"""
WITH {WIDE_SQL}, e AS (SELECT video_id, max(greatest(abs(x), abs(y), abs(z))) AS ext FROM pose_points GROUP BY video_id),
c AS (SELECT p.video_id, p.frame_id, joint, x - (xs[5] + xs[2]) / 2 AS x, -y + (ys[5] + ys[2]) / 2 AS y, z - (zs[5] + zs[2]) / 2 AS z, 680 / (2.2 * ext) AS s
  FROM pose_points p JOIN wide w ON p.video_id = w.video_id AND p.frame_id = w.frame_id JOIN e ON p.video_id = e.video_id),
r AS (SELECT *, x * cos(radians(32)) + z * sin(radians(32)) AS rx, z * cos(radians(32)) - x * sin(radians(32)) AS rz FROM c)
SELECT video_id, frame_id, joint, trunc(480 + rx * s)::INT AS px, trunc(400 - (y * cos(radians(-20)) - rz * sin(radians(-20))) * s)::INT AS py FROM r""")
def _(poses):
    rows = poses.join(ps.axis_extent(poses), "video_id")
    return joints(rows.withColumn("panel", px.rotated_to_panel("pose", 4, 1, "extent", 960, 800)), "panel")


@query("h15_visible_panel", "poses", sql="""
WITH s AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, count(*) OVER w AS n, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY joint) - 1 AS k FROM pose_points WHERE conf > 0.15 WINDOW w AS (PARTITION BY video_id, frame_id)),
e AS (SELECT *, max(greatest(abs(x - mx), abs(y - my))) OVER (PARTITION BY video_id, frame_id) + 1e-6 AS ext FROM s WHERE n >= 2)
SELECT video_id, frame_id, k::INT AS joint, trunc(320 + (x - mx) * (480 * 0.38 / ext))::INT AS px, trunc(240 + (y - my) * (480 * 0.38 / ext))::INT AS py FROM e""")
def _(poses):
    rows = poses.withColumn("panel", px.visible_to_panel("kp", 640, 480)).where("panel IS NOT NULL")
    return joints(rows, "panel")


@query("h16_skeleton_choice", "poses", sql="SELECT DISTINCT video_id, frame_id, video_id % 2 = 0 AS h36m, 16 AS bones FROM pose_points")
def _(poses):
    rows = poses.withColumn("names", F.when(F.col("video_id") % 2 == 0, names(H36M_17)).otherwise(names(COCO_17)))
    h = px.uses_h36m_skeleton("names")
    return rows.select("video_id", "frame_id", h.alias("h36m"), F.when(h, len(px.SKELETONS["h36m"])).otherwise(len(px.SKELETONS["coco"])).alias("bones"))


@query("w21_temporal_window", "poses", sql="""
WITH o AS (SELECT video_id, frame_id, x, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM pose_points WHERE joint = 3),
w AS (SELECT o.video_id, o.frame_id, k, greatest(0, least(o.n - 1, o.pos + k)) AS at FROM o CROSS JOIN range(-4, 5) r(k))
SELECT w.video_id, w.frame_id, count(*) AS len, round(sum(o.x * (k + 5)), 6) + 0.0 AS mix FROM w JOIN o ON w.video_id = o.video_id AND w.at = o.pos GROUP BY w.video_id, w.frame_id""")
def _(poses):
    placed = with_position(poses.select("video_id", "frame_id", F.col("pose")[3]["x"].alias("x")), chunk=POSE_CHUNK)
    out = ps.temporal_windows(placed, 8, "x", chunk=POSE_CHUNK)
    mix = F.aggregate(F.transform("window", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return out.select("video_id", "frame_id", F.size("window").cast("long").alias("len"), r6(mix).alias("mix"))


@query("p9_crop_to_frame", "poses", "track", sql="""
SELECT p.video_id, p.frame_id, joint, round(x + coalesce(t.x1, 0), 6) + 0.0 AS x, round(y + coalesce(t.y1, 0), 6) + 0.0 AS y FROM pose_points p LEFT JOIN track t ON p.video_id = t.video_id AND p.frame_id = t.frame_id""")
def _(poses, track):
    rows = poses.join(track.select("video_id", "frame_id", "x1", "y1"), ["video_id", "frame_id"], "left")
    return rounded(joints(rows.withColumn("m", px.moved_to_frame("kp", "x1", "y1")), "m"), "x", "y").drop("conf")


@query("h17_boxes_from_points", "point_tracks", "dense", "track", sql="""
WITH m AS (SELECT video_id, frame_id, count(*) FILTER (ok) AS nv, avg(px) FILTER (ok) AS mx, avg(py) FILTER (ok) AS my FROM point_tracks GROUP BY ALL),
g AS (SELECT d.video_id, d.frame_id, d.fa, d.fb, a.x2 - a.x1 AS wa, a.y2 - a.y1 AS ha, b.x2 - b.x1 AS wb, b.y2 - b.y1 AS hb, (d.frame_id - d.fa)::DOUBLE / (d.fb - d.fa) AS t, coalesce(nv, 0) AS nv, mx, my
  FROM dense d JOIN track a ON a.video_id = d.video_id AND a.frame_id = d.fa JOIN track b ON b.video_id = d.video_id AND b.frame_id = d.fb LEFT JOIN m ON m.video_id = d.video_id AND m.frame_id = d.frame_id WHERE d.fb - d.fa - 1 >= 2),
k AS (SELECT *, min(nv) OVER (PARTITION BY video_id, fa) AS low, round_even((1 - t) * wa + t * wb, 0)::BIGINT AS w, round_even((1 - t) * ha + t * hb, 0)::BIGINT AS h FROM g),
b AS (SELECT *, round_even(mx - w / 2.0::DOUBLE, 0)::BIGINT AS a1, round_even(my - h / 2.0::DOUBLE, 0)::BIGINT AS b1 FROM k WHERE low >= 2),
c AS (SELECT *, greatest(0, least(a1, 1919)) AS x1, greatest(0, least(b1, 1079)) AS y1 FROM b)
SELECT video_id, frame_id, x1, y1, greatest(x1 + 1, least(a1 + greatest(1, w), 1920)) AS x2, greatest(y1 + 1, least(b1 + greatest(1, h), 1080)) AS y2 FROM c""")
def _(points, dense, track):
    pts = points.select("video_id", "frame_id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("ok").cast("int").cast("double").alias("score"))
    size = lambda tag, at: track.select("video_id", F.col("frame_id").alias(at), (F.col("x2") - F.col("x1")).alias(f"w{tag}"), (F.col("y2") - F.col("y1")).alias(f"h{tag}"))
    gaps = dense.where("fa <> fb").select("video_id", "frame_id", "fa", "fb").join(size("a", "fa"), ["video_id", "fa"]).join(size("b", "fb"), ["video_id", "fb"])
    gaps = gaps.withColumns({"img_w": F.lit(1920).cast("long"), "img_h": F.lit(1080).cast("long")})
    return ps.boxes_from_points(pts, gaps, min_gap=2).select("video_id", "frame_id", *gf.BOX)
