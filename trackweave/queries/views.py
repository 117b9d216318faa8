"""Motion tables derived from the given tables, written once for both engines.

Every view uses its base table whole.  `{table}` is replaced by the base relation, `{D:...}` parts
by the dialect's own spelling.  Videos are groups of ten users (or customers, suppliers), so the
number of videos grows with the data; the image is 1920 x 1080 and a frame is one hour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.geometry import NUDGE
from trackweave.operators.gapfill import fill_linear, frame_spine

IMG_W, IMG_H = 1920, 1080
BASE = ("events", "embeddings", "orders", "lineitem", "customer", "supplier", "part", "nation", "region",
        "documents", "pages", "benchmark", "labels", "conversations")

# name: (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "detections": ((), """
SELECT CAST(floor(CAST(user_id AS DOUBLE) / 10) AS BIGINT) AS video_id,
       CAST((EXTRACT(DAY FROM ts) - 1) * 24 + EXTRACT(HOUR FROM ts) AS BIGINT) AS frame_id,
       event_id AS det_no,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(user_id % 10 AS BIGINT) END AS track_id,
       CAST(200 + (EXTRACT(DAY FROM ts) - 1) * 24 + EXTRACT(HOUR FROM ts) + (event_id * 37) % 160 AS BIGINT) AS x1,
       CAST(100 + (((EXTRACT(DAY FROM ts) - 1) * 24 + EXTRACT(HOUR FROM ts)) * 2) % 600 + (event_id * 53) % 90 AS BIGINT) AS y1,
       CAST(200 + (EXTRACT(DAY FROM ts) - 1) * 24 + EXTRACT(HOUR FROM ts) + (event_id * 37) % 160 + 20 + event_id % 80 AS BIGINT) AS x2,
       CAST(100 + (((EXTRACT(DAY FROM ts) - 1) * 24 + EXTRACT(HOUR FROM ts)) * 2) % 600 + (event_id * 53) % 90 + 40 + event_id % 140 AS BIGINT) AS y2,
       CAST(30 + event_id % 70 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM {events}"""),
    "videos": (("detections",), """
SELECT video_id, CAST(max(frame_id) + 1 + video_id % 5 AS BIGINT) AS n_frames,
       CAST(1920 AS BIGINT) AS img_w, CAST(1080 AS BIGINT) AS img_h
FROM detections GROUP BY video_id"""),
    "frames": (("videos",), """
SELECT v.video_id, {D:frame_col} AS frame_id FROM videos v {D:frame_join}"""),
    "track": (("detections",), """
SELECT video_id, frame_id, det_no, track_id, x1, y1, x2, y2, confidence,
       CAST(x1 + x2 AS DOUBLE) / CAST(2 AS DOUBLE) AS cx, CAST(y1 + y2 AS DOUBLE) / CAST(2 AS DOUBLE) AS cy
FROM (SELECT d.*, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY confidence DESC, det_no) AS rn
      FROM detections d WHERE track_id IS NOT NULL) t
WHERE rn = 1"""),
    "gt_centers": (("track",), """
SELECT video_id, frame_id, CAST(1 AS BIGINT) AS track_id,
       cx + CAST(det_no % 121 - 60 AS DOUBLE) AS center_x, cy + CAST(det_no % 87 - 43 AS DOUBLE) AS center_y
FROM (SELECT t.*, row_number() OVER (PARTITION BY video_id, floor(CAST(frame_id AS DOUBLE) / 10) ORDER BY frame_id) AS kn
      FROM track t) k
WHERE kn = 1"""),
    "camera_flow": (("frames",), """
SELECT video_id, frame_id,
       CAST((video_id * 31 + frame_id * 17) % 13 - 6 AS DOUBLE) / CAST(4 AS DOUBLE) AS dx,
       CAST((video_id * 7 + frame_id * 29 + (frame_id % 97) * frame_id) % 19 - 9 AS DOUBLE) / CAST(4 AS DOUBLE) AS dy
FROM frames"""),
    "dense": (("frames", "track"), """
SELECT video_id, frame_id, det_no IS NOT NULL AS detected, det_no IS NULL AS interpolated, confidence,
       CAST(CASE WHEN fa = fb OR fb IS NULL THEN ax1 WHEN fa IS NULL THEN bx1 ELSE greatest(0, round_even(ax1 + t * (bx1 - ax1), 0)) END AS BIGINT) AS x1,
       CAST(CASE WHEN fa = fb OR fb IS NULL THEN ay1 WHEN fa IS NULL THEN by1 ELSE greatest(0, round_even(ay1 + t * (by1 - ay1), 0)) END AS BIGINT) AS y1,
       CAST(CASE WHEN fa = fb OR fb IS NULL THEN ax2 WHEN fa IS NULL THEN bx2 ELSE least(1920, round_even(ax2 + t * (bx2 - ax2), 0)) END AS BIGINT) AS x2,
       CAST(CASE WHEN fa = fb OR fb IS NULL THEN ay2 WHEN fa IS NULL THEN by2 ELSE least(1080, round_even(ay2 + t * (by2 - ay2), 0)) END AS BIGINT) AS y2,
       CASE WHEN fa = fb THEN NULL ELSE fb - fa - 1 END AS gap_len, fa, fb
FROM (SELECT *, (frame_id - fa)::DOUBLE / (fb - fa) AS t FROM
      (SELECT f.video_id, f.frame_id, t.det_no, coalesce(t.confidence, 0.0) AS confidence,
        last_value(CASE WHEN t.det_no IS NOT NULL THEN t.frame_id END IGNORE NULLS) OVER a AS fa,
        last_value(t.x1 IGNORE NULLS) OVER a AS ax1, last_value(t.y1 IGNORE NULLS) OVER a AS ay1,
        last_value(t.x2 IGNORE NULLS) OVER a AS ax2, last_value(t.y2 IGNORE NULLS) OVER a AS ay2,
        first_value(CASE WHEN t.det_no IS NOT NULL THEN t.frame_id END IGNORE NULLS) OVER b AS fb,
        first_value(t.x1 IGNORE NULLS) OVER b AS bx1, first_value(t.y1 IGNORE NULLS) OVER b AS by1,
        first_value(t.x2 IGNORE NULLS) OVER b AS bx2, first_value(t.y2 IGNORE NULLS) OVER b AS by2
      FROM frames f LEFT JOIN track t ON f.video_id = t.video_id AND f.frame_id = t.frame_id
      WINDOW a AS (PARTITION BY f.video_id ORDER BY f.frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             b AS (PARTITION BY f.video_id ORDER BY f.frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) w) q"""),
    "trace": (("frames",), """
SELECT video_id, frame_id, CAST(280 + frame_id + (video_id * 13 + frame_id * 7) % 41 - 20 AS DOUBLE) AS trace_x,
       CAST(160 + (frame_id * 2) % 600 + (frame_id * 11) % 31 - 15 AS DOUBLE) AS trace_y
FROM frames"""),
    "pred_jumps": ((), """
SELECT CAST(floor(CAST(o_custkey AS DOUBLE) / 100) AS BIGINT) AS video_id, o_orderkey AS jump_id,
       CAST(o_orderkey * 3 + (o_orderkey * 7) % 11 AS BIGINT) AS start_frame,
       CAST(o_orderkey * 3 + (o_orderkey * 7) % 11 + 5 + o_custkey % 20 AS BIGINT) AS end_frame
FROM {orders}"""),
    "gt_jumps_raw": ((), """
SELECT CAST(floor(CAST(o_custkey AS DOUBLE) / 100) AS BIGINT) AS video_id, o_orderkey AS jump_id,
       CAST(o_orderkey * 3 + (o_orderkey * 5) % 13 AS BIGINT) AS start_frame,
       CAST(o_orderkey * 3 + (o_orderkey * 5) % 13 + o_custkey % 25 AS BIGINT) AS end_frame
FROM {orders}"""),
    "gt_jumps": (("gt_jumps_raw",), """
SELECT video_id, jump_id, start_frame, end_frame FROM gt_jumps_raw WHERE end_frame > start_frame"""),
    "pose_points": ((), """
SELECT CAST(label AS BIGINT) AS video_id, vec_id AS frame_id, CAST({D:joint} AS INT) AS joint,
       CAST({D:px} AS DOUBLE) AS x, CAST({D:py} AS DOUBLE) AS y, CAST({D:pz} AS DOUBLE) AS z,
       least(abs(CAST({D:pz} AS DOUBLE)), CAST(1 AS DOUBLE)) AS conf
FROM {embeddings} {D:joint_join}"""),
    "scores": ((), """
SELECT o_orderpriority AS model, o_orderkey AS stem, o_totalprice AS score_true,
       CAST((o_orderkey * 7919) % 100000 AS DOUBLE) + o_totalprice / CAST(2 AS DOUBLE) AS score_pred
FROM {orders}"""),
    "point_tracks": ((), """
SELECT CAST(floor(CAST(l_suppkey AS DOUBLE) / 10) AS BIGINT) AS video_id, CAST(l_partkey % 200 AS BIGINT) AS frame_id,
       l_orderkey AS pt, CAST(l_linenumber AS BIGINT) AS line_no,
       l_quantity - CAST(25 AS DOUBLE) AS dx, l_discount * CAST(100 AS DOUBLE) - CAST(5 AS DOUBLE) AS dy,
       CAST(l_orderkey % 1920 AS DOUBLE) AS px, CAST((l_orderkey * 3) % 1080 AS DOUBLE) AS py,
       l_returnflag <> 'R' AS ok
FROM {lineitem}"""),
    "pixel_flow": ((), """
SELECT CAST(floor(CAST(l_suppkey AS DOUBLE) / 10) AS BIGINT) AS video_id, CAST(l_partkey % 200 AS BIGINT) AS frame_id,
       CAST(l_orderkey % 1920 AS BIGINT) AS px, CAST((l_orderkey * 3) % 1080 AS BIGINT) AS py,
       l_quantity * CAST(5 AS DOUBLE) AS gray, l_tax * CAST(200 AS DOUBLE) AS grad,
       l_quantity / CAST(10 AS DOUBLE) AS dx, l_discount AS dy
FROM {lineitem}"""),
    "gt_venue": (("gt_centers",), """
SELECT video_id, frame_id, center_x AS venue_x, center_y + CAST(frame_id AS DOUBLE) / CAST(2 AS DOUBLE) AS venue_y
FROM (SELECT g.*, row_number() OVER (PARTITION BY video_id, floor(CAST(frame_id AS DOUBLE) / 40) ORDER BY frame_id) AS kn
      FROM gt_centers g) k
WHERE kn = 1"""),
    "venue_candidates": (("detections",), """
SELECT video_id, frame_id, CAST(det_no % 9 AS BIGINT) AS scale_idx, det_no,
       CAST(60 + det_no % 9 AS DOUBLE) / CAST(100 AS DOUBLE) AS scale, confidence AS score,
       CAST(20000 + (det_no * 977) % 300000 AS BIGINT) AS dark_px,
       CAST(x1 AS DOUBLE) AS venue_x, CAST(y1 + frame_id AS DOUBLE) AS venue_y,
       CAST(x2 - x1 AS DOUBLE) AS cx, CAST(y2 - y1 AS DOUBLE) AS cy
FROM detections"""),
    "venue_matches": (("track",), """
SELECT video_id, frame_id, CAST(det_no % 9 AS BIGINT) AS scale_idx, confidence AS score,
       CAST(20000 + (det_no * 977) % 300000 AS BIGINT) AS dark_px,
       cx AS athlete_vx, cy + CAST(frame_id AS DOUBLE) AS athlete_vy
FROM track"""),
    "run_results": ((), """
SELECT l_returnflag AS config, CAST(floor(CAST(l_suppkey AS DOUBLE) / 10) AS BIGINT) AS video_id, l_linestatus AS stage,
       CASE WHEN l_linenumber = 7 THEN CAST(-1 AS DOUBLE) ELSE l_quantity END AS elapsed_s, l_partkey AS n_frames
FROM {lineitem}"""),
}

ALIAS = {"poses": "pose_points"}
OF_FRAMES = ("camera_flow", "trace")
UNHINTED = ("videos", "scores", "run_results", "point_tracks", "pixel_flow", "pose_points")

DIALECT = {
    "spark": {
        "frame_col": "s.frame_id",
        "frame_join": "LATERAL VIEW explode(sequence(CAST(0 AS BIGINT), v.n_frames - 1)) s AS frame_id",
        "joint": "j.joint",
        "joint_join": "LATERAL VIEW explode(sequence(0, 16)) j AS joint",
        "px": "element_at(embedding, j.joint * 3 + 1)",
        "py": "element_at(embedding, j.joint * 3 + 2)",
        "pz": "element_at(embedding, j.joint * 3 + 3)",
    },
    "duckdb": {
        "frame_col": "CAST(s.frame_id AS BIGINT)",
        "frame_join": ", LATERAL (SELECT unnest(range(v.n_frames)) AS frame_id) s",
        "joint": "j.joint",
        "joint_join": ", LATERAL (SELECT unnest(range(17)) AS joint) j",
        "px": "embedding[CAST(j.joint * 3 + 1 AS INT)]",
        "py": "embedding[CAST(j.joint * 3 + 2 AS INT)]",
        "pz": "embedding[CAST(j.joint * 3 + 3 AS INT)]",
    },
}


def _needed(names: tuple[str, ...]) -> list[str]:
    wanted: set[str] = set()

    def add(name: str) -> None:
        name = ALIAS.get(name, name)
        for dep in VIEWS[name][0]:
            add(dep)
        wanted.add(name)

    for name in names:
        add(name)
    return [name for name in VIEWS if name in wanted]


def _text(name: str, dialect: str) -> str:
    return reduce(lambda sql, kv: sql.replace("{D:%s}" % kv[0], kv[1]), DIALECT[dialect].items(), VIEWS[name][1])


def _ctes(names: tuple[str, ...], dialect: str) -> str:
    return ",\n".join(f"{name} AS ({_text(name, dialect)}\n)" for name in _needed(names))


def nudged(sql: str) -> str:
    """`round(x, n) + 0.0` with the nudge the Spark side uses, for n of 4 to 6."""
    out, at = [], 0
    while True:
        start = sql.find("round(", at)
        if start < 0:
            return "".join([*out, sql[at:]])
        depth, end = 0, start + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if not depth:
                break
            end += 1
        inner = sql[start + 6:end]
        if inner[-3:] in (", 4", ", 5", ", 6") and sql[end + 1:end + 7] == " + 0.0":
            out.append(f"{sql[at:start]}round(({nudged(inner[:-3])}) + {NUDGE}, {inner[-1]})")
        else:
            out.append(f"{sql[at:start]}round({nudged(inner)})")
        at = end + 1


def oracle(body: str, *names: str) -> str:
    """DuckDB statement with the views it needs in front; `body` may open with further CTEs."""
    sql = _ctes(names, "duckdb")
    for base in BASE:
        sql = sql.replace("{%s}" % base, base)
    body = nudged(body.strip())
    if not sql:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {sql},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {sql},\n{body[5:]}"
    return f"WITH {sql}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def poses(embeddings: DataFrame) -> DataFrame:
    """One row per frame with 2D keypoints `kp` and 3D joints `pose`."""
    at = lambda j, k: F.element_at("embedding", j * 3 + k).cast("double")
    joints = F.sequence(F.lit(0), F.lit(16))
    return embeddings.select(
        F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("frame_id"),
        F.transform(joints, lambda j: F.struct(
            at(j, 1).alias("x"), at(j, 2).alias("y"), F.least(F.abs(at(j, 3)), F.lit(1.0)).alias("conf"))).alias("kp"),
        F.transform(joints, lambda j: F.struct(at(j, 1).alias("x"), at(j, 2).alias("y"), at(j, 3).alias("z"))).alias("pose"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "dense":  # the library's own gap filling; SQL only for the check
        return fill_linear(view(spark, sf_dir, "track"), view(spark, sf_dir, "videos")).select(
            "video_id", "frame_id", "detected", "interpolated", "confidence", "x1", "y1", "x2", "y2",
            "gap_len", "fa", "fb")
    if name == "frames":  # likewise
        return frame_spine(view(spark, sf_dir, "videos")).select("video_id", "frame_id")
    if name in OF_FRAMES:
        return spark.sql(_text(name, "spark").replace("FROM frames", "FROM {frames}"), frames=view(spark, sf_dir, "frames")).hint("merge")
    if name == "poses":  # nested form of pose_points
        return poses(table(spark, sf_dir, "embeddings"))
    sql = f"WITH {_ctes((name,), 'spark')}\nSELECT * FROM {name}"
    used = {base: table(spark, sf_dir, base) for base in BASE if "{%s}" % base in sql}
    made = spark.sql(sql, **used)
    # Spark sizes a view by the compressed file and the share of its columns, which may be a hundredth of the rows a broadcast would
    # collect in the driver.  Not where a view is small or is joined with totals of a few large groups, which a merge would not spread.
    return made if name in UNHINTED else made.hint("merge")
