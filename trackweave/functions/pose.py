"""Pose expressions over arrays of 17 joint structs: (x, y, conf) in 2D and (x, y, z) in 3D."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.geometry import col
from trackweave.functions.skeleton import ANGLES, COCO_17, COCO_BONES, H36M_17, H36M_BONES, MIRROR_PAIRS

N_JOINTS = 17


def let(value: Column, use) -> Column:
    """`use(value)` with the value evaluated once, not once per element of an inner lambda."""
    return F.transform(F.array(value), use)[0]


def point(x, y, conf) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), conf.alias("conf"))


def midpoint(a: Column, b: Column) -> Column:
    """Mean position, smaller confidence."""
    return point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2, F.least(a["conf"], b["conf"]))


def head_point(kp: Column, thorax: Column) -> Column:
    """Confidence-weighted mean of the five face points; the thorax when none is confident."""
    face = [kp[i] for i in range(5)]
    weight = sum((p["conf"] for p in face), F.lit(0.0))
    floor = F.greatest(weight, F.lit(1e-6))
    mean = lambda f: sum((p[f] * p["conf"] for p in face), F.lit(0.0)) / floor
    return F.when(weight > 0, point(mean("x"), mean("y"), F.greatest(*[p["conf"] for p in face]))).otherwise(thorax)


def coco_to_h36m(keypoints) -> Column:
    kp = col(keypoints)
    at = {name: kp[i] for i, name in enumerate(COCO_17)}
    pelvis = midpoint(at["left_hip"], at["right_hip"])
    thorax = midpoint(at["left_shoulder"], at["right_shoulder"])
    built = {"pelvis": pelvis, "thorax": thorax, "spine": midpoint(pelvis, thorax), "neck": thorax, "head": head_point(kp, thorax)}
    return F.array(*[built.get(name, at.get(name)) for name in H36M_17])


def to_h36m(keypoints, names) -> Column:
    """H36M order whatever the input order; names that are neither convention raise an error."""
    lowered = F.transform(col(names), F.lower)
    same = lambda ref: lowered == F.array(*[F.lit(n) for n in ref])
    return (
        F.when(same(H36M_17), col(keypoints)).when(same(COCO_17), coco_to_h36m(keypoints))
        .otherwise(F.raise_error(F.lit("keypoint_names must be COCO-17 or H36M-17")))
    )


def hip_index(names, side: str) -> Column:
    """0-based index of `left_hip` / `right_hip`; missing names raise an error."""
    at = F.array_position(F.transform(col(names), F.lower), f"{side}_hip")
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.lit("keypoint_names must include both hips")))


def centred_and_scaled(keypoints, left, right) -> Column:
    """Hip midpoint at the origin, largest coordinate about 1."""
    kp = col(keypoints)
    hips = let(F.struct(F.get(kp, col(left)).alias("l"), F.get(kp, col(right)).alias("r")), lambda h: F.struct(
        ((h["l"]["x"] + h["r"]["x"]) / 2).alias("x"), ((h["l"]["y"] + h["r"]["y"]) / 2).alias("y")))

    def scaled(o: Column) -> Column:
        extent = F.array_max(F.transform(kp, lambda p: F.greatest(F.abs(p["x"] - o["x"]), F.abs(p["y"] - o["y"])))) + 1e-6
        return let(extent, lambda e: F.transform(kp, lambda p: point((p["x"] - o["x"]) / e, (p["y"] - o["y"]) / e, p["conf"])))

    return let(hips, scaled)


def naive_lift(normalised) -> Column:
    """Depth proportional to height: z = -0.3 y."""
    return F.transform(col(normalised), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["y"] * -0.3).alias("z")))


def mirrored(pose) -> Column:
    """Left and right joints swapped, x negated."""
    other = {a: b for pair in MIRROR_PAIRS for a, b in (pair, pair[::-1])}
    p = col(pose)
    return F.array(*[
        F.struct((-p[other.get(j, j)]["x"]).alias("x"), p[other.get(j, j)]["y"].alias("y"), p[other.get(j, j)]["z"].alias("z"))
        for j in range(N_JOINTS)])


def joint_angle(pose, a: int, b: int, c: int) -> Column:
    """Angle at joint b in radians; bone lengths are floored at 1e-8 and the cosine is clipped."""
    p = col(pose)
    u = [p[a][k] - p[b][k] for k in "xyz"]
    v = [p[c][k] - p[b][k] for k in "xyz"]
    norm = lambda w: F.greatest(F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2]), F.lit(1e-8))
    nu, nv = norm(u), norm(v)
    cosine = sum((i / nu * (j / nv) for i, j in zip(u, v)), F.lit(0.0))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def joint_angles(pose) -> Column:
    return F.array(*[joint_angle(pose, *t) for t in ANGLES])


def body_height(pose) -> Column:
    """Distance from the head to the middle of the ankles."""
    p = col(pose)
    d = [p[10][k] - (p[3][k] + p[6][k]) / 2 for k in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def joint_speeds(pose, previous) -> Column:
    return F.zip_with(col(pose), col(previous), lambda a, b: F.sqrt(
        (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) + (a["z"] - b["z"]) * (a["z"] - b["z"])))


def uses_h36m_skeleton(names) -> Column:
    lowered = F.transform(col(names), F.lower)
    return F.array_contains(lowered, "pelvis") & F.array_contains(lowered, "thorax")


def visible_bones(keypoints, bones: Sequence[tuple[int, int]] = COCO_BONES, threshold: float = 0.3) -> Column:
    """Bones with both ends above the confidence threshold, with their end points."""
    kp = col(keypoints)
    rows = [
        F.when((kp[i]["conf"] > threshold) & (kp[j]["conf"] > threshold), F.struct(
            F.lit(i).alias("parent"), F.lit(j).alias("child"), kp[i]["x"].alias("x1"), kp[i]["y"].alias("y1"), kp[j]["x"].alias("x2"), kp[j]["y"].alias("y2")))
        for i, j in bones]
    return F.array_compact(F.array(*rows))


def rotated_to_panel(pose, left: int, right: int, extent, width: int, height: int, margin: int = 60, yaw: float = 32.0, pitch: float = -20.0) -> Column:
    """Panel pixels of a 3D pose: y flipped, hips centred, turned by yaw then pitch, scaled by extent."""
    p = col(pose)
    cy, sy = math.cos(math.radians(yaw)), math.sin(math.radians(yaw))
    cp, sp = math.cos(math.radians(pitch)), math.sin(math.radians(pitch))
    frame = F.struct(
        ((p[left]["x"] + p[right]["x"]) / 2).alias("x"), ((-p[left]["y"] - p[right]["y"]) / 2).alias("y"),
        ((p[left]["z"] + p[right]["z"]) / 2).alias("z"), (F.lit(float(min(width, height) - 2 * margin)) / (col(extent) * 2.2)).alias("scale"))

    def place(q: Column, o: Column) -> Column:
        x, y, z = q["x"] - o["x"], -q["y"] - o["y"], q["z"] - o["z"]
        rx, rz = x * cy + z * sy, z * cy - x * sy
        ry = y * cp - rz * sp
        return F.struct((F.lit(width // 2) + rx * o["scale"]).cast("int").alias("px"), (F.lit(height // 2) - ry * o["scale"]).cast("int").alias("py"))

    return let(frame, lambda o: F.transform(p, lambda q: place(q, o)))


def visible_to_panel(keypoints, width: int, height: int, threshold: float = 0.15) -> Column:
    """Panel pixels of the visible joints around their mean; null with fewer than two of them."""
    seen = F.filter(col(keypoints), lambda p: p["conf"] > threshold)

    def placed(pts: Column) -> Column:
        mean = lambda f: F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p[f]) / F.size(pts)
        return let(F.struct(mean("x").alias("x"), mean("y").alias("y")), lambda o: around(pts, o))

    def around(pts: Column, o: Column) -> Column:
        extent = F.array_max(F.transform(pts, lambda p: F.greatest(F.abs(p["x"] - o["x"]), F.abs(p["y"] - o["y"])))) + 1e-6
        return let(F.lit(min(width, height) * 0.38) / extent, lambda s: F.transform(pts, lambda p: F.struct(
            (F.lit(width // 2) + (p["x"] - o["x"]) * s).cast("int").alias("px"), (F.lit(height // 2) + (p["y"] - o["y"]) * s).cast("int").alias("py"))))

    return let(seen, lambda pts: F.when(F.size(pts) >= 2, placed(pts)))


def moved_to_frame(keypoints, dx, dy) -> Column:
    """Crop coordinates back in the frame; without an offset they stay as they are."""
    ox, oy = F.coalesce(col(dx), F.lit(0)), F.coalesce(col(dy), F.lit(0))
    return F.transform(col(keypoints), lambda p: point(p["x"] + ox, p["y"] + oy, p["conf"]))


SKELETONS = {"coco": COCO_BONES, "h36m": H36M_BONES}
