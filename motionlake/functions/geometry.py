"""Rotations, poses and projections as Column functions. Quaternions are structs (w, x, y, z)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quat(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def norm(q: Column) -> Column:
    return F.sqrt(q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])


def normalized(q: Column) -> Column:
    """Unit quaternion; null where the norm is next to nothing."""
    n = F.when(norm(q) >= 1e-12, norm(q))
    return quat(*[q[c] / n for c in "wxyz"])


def canonical(q: Column) -> Column:
    """The one of q and -q with w >= 0."""
    s = F.when(q["w"] < 0, -1.0).otherwise(1.0)
    return quat(*[q[c] * s for c in "wxyz"])


def multiply(p: Column, q: Column) -> Column:
    """Hamilton product, canonical."""
    return canonical(
        quat(
            p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"],
            p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"],
            p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"],
            p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"],
        )
    )


def dot(p: Column, q: Column) -> Column:
    return p["w"] * q["w"] + p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]


def angle_between(p: Column, q: Column) -> Column:
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot(p, q))))


def slerp(p: Column, q: Column, a: float | Column) -> Column:
    """Along the shorter arc; linear where the two almost agree."""
    a = F.lit(a) if isinstance(a, (int, float)) else a
    d, sign = F.least(F.abs(dot(p, q)), F.lit(1.0)), F.when(dot(p, q) < 0, -1.0).otherwise(1.0)
    theta = F.acos(d)
    close = theta < 1e-6
    s = F.when(close, F.lit(1.0)).otherwise(F.sin(theta))
    wp = F.when(close, 1 - a).otherwise(F.sin((1 - a) * theta) / s)
    wq = F.when(close, a).otherwise(F.sin(a * theta) / s) * sign
    mixed = let(F.struct(wp.alias("p"), wq.alias("q")), lambda w: quat(*[w["p"] * p[c] + w["q"] * q[c] for c in "wxyz"]))
    return let(mixed, normalized)


def to_matrix(q: Column) -> list[Column]:
    """Nine elements, row by row, of a unit quaternion's matrix."""
    w, x, y, z = (q[c] for c in "wxyz")
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def rotate(m: list[Column], p: list[Column]) -> list[Column]:
    return [m[3 * i] * p[0] + m[3 * i + 1] * p[1] + m[3 * i + 2] * p[2] for i in range(3)]


def transform(m: list[Column], t: list[Column], p: list[Column]) -> list[Column]:
    return [r + t[i] for i, r in enumerate(rotate(m, p))]


def inverse(m: list[Column], t: list[Column]) -> tuple[list[Column], list[Column]]:
    """Of a rotation and a translation."""
    back = [m[3 * j + i] for i in range(3) for j in range(3)]
    return back, [-r for r in rotate(back, t)]


def compose(m1: list[Column], t1: list[Column], m2: list[Column], t2: list[Column]) -> tuple[list[Column], list[Column]]:
    m = [sum((m1[3 * i + k] * m2[3 * k + j] for k in range(1, 3)), m1[3 * i] * m2[j]) for i in range(3) for j in range(3)]
    return m, transform(m1, t1, t2)


def axis_angle(q: Column) -> list[Column]:
    """Axis times angle, the angle within [0, pi]."""
    c = canonical(q)
    s = F.sqrt(c["x"] * c["x"] + c["y"] * c["y"] + c["z"] * c["z"])
    k = F.when(s < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(s, c["w"]) / s)
    return [c[n] * k for n in "xyz"]


def project(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel of a point before the camera; null behind it."""
    depth = F.when(z > 1e-6, z)
    return fx * x / depth + cx, fy * y / depth + cy


def outside_distance(u: Column, v: Column, width: float, height: float) -> Column:
    zero = F.lit(0.0)
    return F.hypot(F.greatest(-u, u - width, zero), F.greatest(-v, v - height, zero))


def focal_length(fov_deg: Column, width: float) -> Column:
    """Of a horizontal field of view, held within 20 to 120 degrees."""
    return width / (2 * F.tan(F.radians(F.least(F.greatest(fov_deg, F.lit(20.0)), F.lit(120.0))) / 2))


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(union > 1e-9, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / union).otherwise(0.0)


def two_link_ik(dx: Column, dz: Column, upper: float, lower: float) -> tuple[Column, Column]:
    """Hip and knee angle of a leg whose foot is at (dx, dz) from the hip, dz downwards; reach is held to what the leg has."""
    r = F.least(F.greatest(F.hypot(dx, dz), F.lit(abs(upper - lower) + 1e-6)), F.lit(upper + lower - 1e-6))
    clip = lambda c: F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))
    knee = F.lit(3.141592653589793) - F.acos(clip((upper * upper + lower * lower - r * r) / (2 * upper * lower)))
    lift = F.acos(clip((upper * upper + r * r - lower * lower) / (2 * upper * r)))
    return F.atan2(dx, dz) + lift, -knee


def total(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def length(v: list[Column]) -> Column:
    return F.sqrt(total([c * c for c in v]))


def swapped(q: Column) -> Column:
    """The same quaternion with w last."""
    return F.struct(*[q[c].alias(c) for c in "xyzw"])


def from_matrix(m: list[Column]) -> Column:
    """Canonical quaternion of a rotation matrix, from its largest component on, so nothing small is divided by."""

    def of(a: Column) -> Column:
        m = [F.get(a, F.lit(i)) for i in range(9)]
        squares = [1 + m[0] + m[4] + m[8], 1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8]]
        most = F.greatest(*squares)
        pairs = {(0, 1): m[7] - m[5], (0, 2): m[2] - m[6], (0, 3): m[3] - m[1], (1, 2): m[1] + m[3], (1, 3): m[2] + m[6], (2, 3): m[5] + m[7]}
        case = F
        for i in range(4):
            case = case.when(squares[i] == most, quat(*[most if i == j else pairs[min(i, j), max(i, j)] for j in range(4)]))
        return case

    return let(let(let(F.array(*m), of), normalized), canonical)


def from_axis_angle(v: list[Column]) -> Column:
    """Canonical quaternion of axis times angle."""

    def of(x: Column) -> Column:
        v, a = [F.get(x, F.lit(i)) for i in range(3)], F.get(x, F.lit(3))
        s = F.when(a < 1e-12, F.lit(0.5)).otherwise(F.sin(a / 2) / F.when(a >= 1e-12, a))
        return quat(F.cos(a / 2), *[c * s for c in v])

    whole = let(F.array(*v), lambda x: F.concat(x, F.array(length([F.get(x, F.lit(i)) for i in range(3)]))))
    return let(let(whole, of), canonical)


def flatten(m: list[Column], t: list[Column]) -> Column:
    """Sixteen numbers of a rotation and translation, row by row."""
    rows = [[*m[3 * i : 3 * i + 3], t[i]] for i in range(3)] + [[F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    return F.array(*[c for row in rows for c in row])


def unflatten(a: Column) -> tuple[list[Column], list[Column]]:
    at = lambda i, j: F.get(a, F.lit(4 * i + j))
    return [at(i, j) for i in range(3) for j in range(3)], [at(i, 3) for i in range(3)]


def is_rotation(m: list[Column], tolerance: float = 1e-5) -> Column:
    """Whether columns are orthonormal and the determinant is 1."""
    columns = [[m[3 * i + j] for i in range(3)] for j in range(3)]
    off = [F.abs(total([a * b for a, b in zip(columns[i], columns[j], strict=True)]) - (1 if i == j else 0)) for i in range(3) for j in range(i, 3)]
    det = total([a * b for a, b in zip(columns[0], cross(columns[1], columns[2]), strict=True)])
    return (F.greatest(*off) < tolerance) & (F.abs(det - 1) < tolerance)


def similar(scale: Column, m: list[Column], t: list[Column], p: list[Column]) -> list[Column]:
    """A point under a similarity."""
    return [scale * r + t[i] for i, r in enumerate(rotate(m, p))]


def similar_pose(scale: Column, m: list[Column], t: list[Column], rotation: list[Column], position: list[Column]) -> tuple[list[Column], list[Column]]:
    """A pose under a similarity: its rotation isn't scaled."""
    turned, _ = compose(m, [F.lit(0.0)] * 3, rotation, [F.lit(0.0)] * 3)
    return turned, similar(scale, m, t, position)


def back_project(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    """The point before the camera that the middle of a pixel shows; null without a depth."""
    d = F.when(depth > 0, depth)
    return [(u + 0.5 - cx) * d / fx, (v + 0.5 - cy) * d / fy, d]


def look_at(eye: list[Column], target: list[Column]) -> list[Column]:
    """Rotation of a camera (axes right, down, forward as columns) that looks from eye to target, with z upwards."""
    unit = lambda v: [c / (length(v) + 1e-8) for c in v]
    forward = unit([b - a for a, b in zip(eye, target, strict=True)])
    right = unit(cross(forward, [F.lit(0.0), F.lit(0.0), F.lit(1.0)]))
    down = [-c for c in cross(right, forward)]
    return [axis[i] for i in range(3) for axis in (right, down, forward)]


def min_jerk(x: Column) -> Column:
    """Smooth step from 0 to 1."""
    c = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return c * c * c * (10.0 - 15.0 * c + 6.0 * c * c)


# Shares of a grasping cycle at which it reaches, grips, lifts, lowers and lets go.
REACHED, GRIPPED, LIFTED, LOWERED, FREED = 0.30, 0.40, 0.55, 0.70, 0.80


def grasp_phases(tau: Column) -> tuple[Column, Column, Column]:
    """Reach, grip and lift (0 to 1) at a share of a cycle."""
    ramp = lambda a, b: min_jerk((tau - a) / (b - a))
    reach = F.when(tau < REACHED, ramp(0.0, REACHED)).when(tau < FREED, 1.0).otherwise(1.0 - ramp(FREED, 1.0))
    grip = F.when(tau < REACHED, 0.0).when(tau < GRIPPED, ramp(REACHED, GRIPPED)).when(tau < LOWERED, 1.0).when(tau < FREED, 1.0 - ramp(LOWERED, FREED)).otherwise(0.0)
    lift = F.when(tau.between(GRIPPED, LIFTED) & (tau < LIFTED), ramp(GRIPPED, LIFTED)).when((tau >= LIFTED) & (tau < LOWERED), 1.0 - ramp(LIFTED, LOWERED)).otherwise(0.0)
    return reach, grip, lift


def joint_angle(a: list[Column], b: list[Column]) -> Column:
    """Angle at a joint between the segment that comes in (a) and the one that goes on (b), pi if they are in line."""
    cosine = -total([x * y for x, y in zip(a, b, strict=True)]) / (length(a) * length(b) + 1e-9)
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def in_body(p: list[Column], middle: list[Column], fore: list[Column], hind: list[Column], body: Column) -> list[Column]:
    """A point of the image along and across a body's axis, in body lengths."""
    axis = [a - b for a, b in zip(fore, hind, strict=True)]
    size = F.when(length(axis) >= 1e-6, length(axis))
    x, y = (c / size for c in axis)
    d = [a - b for a, b in zip(p, middle, strict=True)]
    return [(d[0] * x + d[1] * y) / body, (d[1] * x - d[0] * y) / body]


def posture(height_ratio: Column) -> Column:
    return F.when(height_ratio.isNull(), "unknown").when(height_ratio > 0.55, "standing_or_walking").otherwise("recumbent_or_low")


def fusion_confidence(rms: Column) -> Column:
    return F.exp(-rms / 0.05)
