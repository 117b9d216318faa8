"""Pose sequences: temporal windows, speeds, features, training samples and skeleton graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import pose as px
from trackweave.functions.geometry import clamp_box
from trackweave.functions.skeleton import ANGLES, H36M_BONES
from trackweave.operators.series import CHUNK_FRAMES, FRAME, VIDEO, halo_window, running, with_position

ANGLE_STATS = ("mean", "std", "min", "max", "range", "skew")
PLAIN_STATS = ("mean", "std", "max", "range")


def temporal_windows(poses: DataFrame, field: int, column: str, *, pos: str = "pos", chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Window of `field` frames (made odd) around each frame, edges repeated; `pos` must be dense."""
    field = max(1, field)
    half = (field + 1 if field % 2 == 0 else field) // 2

    def columns(w):
        around = w.rowsBetween(-half, half)
        rows = F.collect_list(F.struct(pos, F.col(column).alias("v"))).over(around)
        return {"_rows": rows}

    out = halo_window(poses, columns, pos=pos, before=half, after=half, chunk=max(chunk, half))
    got = F.transform("_rows", lambda r: r["v"])
    left = F.lit(half) - (F.col(pos) - F.col("_rows")[0][pos])
    right = F.lit(half) - (F.element_at("_rows", -1)[pos] - F.col(pos))
    padded = F.concat(
        F.array_repeat(F.element_at(got, 1), left.cast("int")), got, F.array_repeat(F.element_at(got, -1), right.cast("int")))
    return out.withColumn("window", padded).drop("_rows")


def pose_speeds(poses: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Displacement of every joint since the previous row; the first row of a video has none."""
    stepped = running(poses, prevs={"_p": F.col("pose")}, chunk=chunk)
    return stepped.where(F.col("_p").isNotNull()).withColumn("speeds", px.joint_speeds("pose", "_p")).drop("_p")


def stats(signal: Column, names: Sequence[str]) -> list[Column]:
    """Population statistics; skewness is 0 for constant or very short signals."""
    std = F.stddev_pop(signal)
    known = {
        "mean": F.avg(signal), "std": std, "min": F.min(signal), "max": F.max(signal), "range": F.max(signal) - F.min(signal),
        "skew": F.when((F.count(signal) < 3) | (std < 1e-10), F.lit(0.0)).otherwise(F.skewness(signal)),
    }
    return [known[n] for n in names]


def pose_features(poses: DataFrame, *, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """The 144 features of a video in fixed order: 12 angles, 17 joint speeds, body height.

    One aggregation over wide rows; frames are not multiplied by the number of signals.
    """
    stepped = running(poses, prevs={"_p": F.col("pose")}, chunk=chunk)
    rows = stepped.select(
        *VIDEO, px.joint_angles("pose").alias("angles"), px.joint_speeds("pose", "_p").alias("speeds"), px.body_height("pose").alias("height"))
    aggs = [c for i in range(len(ANGLES)) for c in stats(F.col("angles")[i], ANGLE_STATS)]
    aggs += [c for j in range(px.N_JOINTS) for c in stats(F.col("speeds")[j], PLAIN_STATS)]
    aggs += stats(F.col("height"), PLAIN_STATS)
    wide = rows.groupBy(*VIDEO).agg(*[c.alias(f"f{i}") for i, c in enumerate(aggs)])
    return wide.select(*VIDEO, F.array(*[F.col(f"f{i}") for i in range(len(aggs))]).alias("features"))


def axis_extent(poses: DataFrame) -> DataFrame:
    """Largest absolute coordinate of a video."""
    per = F.array_max(F.transform("pose", lambda p: F.greatest(F.abs(p["x"]), F.abs(p["y"]), F.abs(p["z"]))))
    return poses.groupBy(*VIDEO).agg(F.max(per).alias("extent"))


def _uniform(seed: int, *parts) -> Column:
    """Reproducible number in (0, 1): depends on the row's keys, not on partitioning or retries."""
    h = F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.col(p) for p in parts], F.lit(seed)), F.lit(1 << 52))
    return (h + 0.5) / F.lit(float(1 << 52))


def augmented(poses: DataFrame, *, noise: float = 0.005, seed: int = 0) -> DataFrame:
    """Mirror half of the videos and add Gaussian coordinate noise."""
    flip = _uniform(seed, *VIDEO) < 0.5
    base = poses.withColumn("pose", F.when(flip, px.mirrored("pose")).otherwise(F.col("pose")))

    def jitter(j: Column, axis: int) -> Column:
        u1, u2 = _uniform(seed + 1, *VIDEO, FRAME, j, F.lit(axis)), _uniform(seed + 2, *VIDEO, FRAME, j, F.lit(axis))
        return F.sqrt(F.log(u1) * -2) * F.cos(u2 * 6.283185307179586) * noise

    return base.withColumn("pose", F.transform("pose", lambda p, j: F.struct(
        (p["x"] + jitter(j, 0)).alias("x"), (p["y"] + jitter(j, 1)).alias("y"), (p["z"] + jitter(j, 2)).alias("z"))))


def fixed_length(poses: DataFrame, length: int, *, seed: int = 0, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """A random crop of longer sequences; shorter ones repeat their last frame.  Rows get a `slot`."""
    placed = with_position(poses, "_pos", chunk=chunk)
    total = poses.groupBy(*VIDEO).agg(F.count(F.lit(1)).alias("_n"))
    start = F.when(F.col("_n") > length, F.floor(_uniform(seed, *VIDEO) * (F.col("_n") - length + 1))).otherwise(F.lit(0))
    rows = placed.join(total, list(VIDEO)).withColumn("_slot", F.col("_pos") - start)
    rows = rows.where((F.col("_slot") >= 0) & (F.col("_slot") < length))
    last = (F.col("_pos") == F.col("_n") - 1) & (F.col("_n") < length)
    until = F.when(last, F.lit(length - 1).cast("long")).otherwise(F.col("_slot"))
    return rows.withColumn("slot", F.explode(F.sequence(F.col("_slot"), until))).drop("_pos", "_n", "_slot")


def channel_rows(poses: DataFrame) -> DataFrame:
    """Channel-major form: one row per video, channel (x, y, z) and frame with its 17 values."""
    pick = lambda axis: F.transform("pose", lambda p: p[axis])
    rows = [F.struct(F.lit(k).alias("channel"), pick(axis).alias("values")) for k, axis in enumerate("xyz")]
    return poses.select(*VIDEO, FRAME, F.inline(F.array(*rows)))


def long_to_nested(points: DataFrame) -> DataFrame:
    """Joint rows back to one array per frame, ordered by joint."""
    ordered = F.array_sort(F.collect_list(F.struct("joint", "x", "y", "z")))
    out = points.groupBy(*VIDEO, FRAME).agg(ordered.alias("_j"))
    return out.select(*VIDEO, FRAME, F.transform("_j", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("pose"))


def nested_to_long(poses: DataFrame) -> DataFrame:
    return poses.select(*VIDEO, FRAME, F.posexplode("pose").alias("joint", "p")).select(*VIDEO, FRAME, "joint", "p.x", "p.y", "p.z")


def skeleton_adjacency(spark: SparkSession, bones: Sequence[tuple[int, int]] = H36M_BONES) -> DataFrame:
    """Edges of the self, root-ward and leaf-ward partitions with weights D^-1/2 A D^-1/2.

    D holds row sums, so an edge whose column joint has an empty row gets weight 0.
    """
    edges = [(0, j, j) for j in range(px.N_JOINTS)]
    edges += [(1, parent, child) for parent, child in bones] + [(2, child, parent) for parent, child in bones]
    e = spark.createDataFrame(edges, "part int, i int, j int")
    degree = e.groupBy("part", "i").agg(F.count(F.lit(1)).alias("d"))
    row = degree.withColumnRenamed("d", "di")
    column = degree.select("part", F.col("i").alias("j"), F.col("d").alias("dj"))
    weight = F.when(F.col("dj").isNull(), 0.0).otherwise(F.lit(1.0) / F.sqrt(F.col("di") * F.coalesce("dj", F.lit(1))))
    return e.join(row, ["part", "i"]).join(column, ["part", "j"], "left").select("part", "i", "j", weight.alias("w"))


def boxes_from_points(
    points: DataFrame, gaps: DataFrame, *, min_gap: int = 5, min_visible: int = 2, min_score: float = 0.5, scale_x: float = 1.0, scale_y: float = 1.0,
) -> DataFrame:
    """Boxes of gap frames rebuilt around the mean of the visible tracked points.

    `points`: video, frame, x, y, score.  `gaps`: one row per internal gap frame with the anchors' frames
    `fa`, `fb` and sizes wa, ha, wb, hb.  A gap is given up whole when one of its frames has too few
    visible points.
    """
    seen = F.col("score") > min_score
    means = points.groupBy(*VIDEO, FRAME).agg(
        F.count_if(seen).alias("n_visible"), F.avg(F.when(seen, F.col("x"))).alias("mx"), F.avg(F.when(seen, F.col("y"))).alias("my"))
    rows = gaps.where(F.col("fb") - F.col("fa") - 1 >= min_gap).join(means, [*VIDEO, FRAME], "left")
    rows = rows.withColumn("n_visible", F.coalesce("n_visible", F.lit(0)))
    kept = rows.groupBy(*VIDEO, "fa").agg(F.min("n_visible").alias("_low")).where(F.col("_low") >= min_visible)
    rows = rows.join(kept, [*VIDEO, "fa"], "left_semi")
    t = (F.col(FRAME) - F.col("fa")) / (F.col("fb") - F.col("fa"))
    size = lambda a, b: F.rint((F.lit(1.0) - t) * F.col(a) + t * F.col(b)).cast("long")
    w, h = size("wa", "wb"), size("ha", "hb")
    x1 = F.rint(F.col("mx") / scale_x - w / 2).cast("long")
    y1 = F.rint(F.col("my") / scale_y - h / 2).cast("long")
    one = F.lit(1).cast("long")
    box = clamp_box(x1, y1, x1 + F.greatest(one, w), y1 + F.greatest(one, h), "img_w", "img_h")
    return rows.select(*VIDEO, FRAME, *[v.alias(k) for k, v in box.items()])
