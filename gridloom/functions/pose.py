"""Angles, poses, quaternions and rotations as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbers import bind

PI = math.pi


def normalize_degrees(a: Column) -> Column:
    """In (-180, 180]."""
    m = F.pmod(a.cast("double"), F.lit(360.0))
    return F.when(m > 180, m - 360).otherwise(m)


def normalize_radians(a: Column) -> Column:
    """In (-pi, pi]."""
    m = F.pmod(a.cast("double"), F.lit(2 * PI))
    return F.when(m > PI, m - 2 * PI).otherwise(m)


def distance(*pairs: tuple[Column, Column]) -> Column:
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + (a - b) * (a - b)
    return F.sqrt(total)


def relative_pose(x1, y1, o1, x2, y2, o2) -> Column:
    """(dx, dy, do) from pose 1 to pose 2, in the frame of pose 1; angles in radians."""
    theta = F.atan2(y2 - y1, x2 - x1) - o1
    far = distance((x2, x1), (y2, y1))
    return F.struct((far * F.cos(theta)).alias("dx"), (far * F.sin(theta)).alias("dy"), (o2 - o1).alias("do"))


def pose_deltas(df: DataFrame, key: str, order: list[str], x: str, y: str, o: str) -> DataFrame:
    """df with dx, dy, do from each key's pose before; the first row has nulls."""
    w = Window.partitionBy(key).orderBy(*order)
    p = lambda c: F.lag(c).over(w)
    d = relative_pose(p(x), p(y), p(o), F.col(x), F.col(y), F.col(o))
    return df.withColumn("_d", d).select(*df.columns, "_d.dx", "_d.dy", "_d.do")


def integrate_poses(df: DataFrame, key: str, order: list[str], dx: str, dy: str, do_deg: str, start=(0.0, 0.0, 0.0)) -> DataFrame:
    """df with the pose (x, y, heading_deg) after each step.

    A step is turned by the heading before it.  Two running sums over one ordering; the heading
    is wrapped in the output only.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    turned = df.withColumn("_h", F.radians(F.lit(start[2]) + F.coalesce(F.sum(do_deg).over(before), F.lit(0.0))))
    sx = F.col(dx) * F.cos("_h") - F.col(dy) * F.sin("_h")
    sy = F.col(dx) * F.sin("_h") + F.col(dy) * F.cos("_h")
    return (
        turned.withColumn("_sx", sx)
        .withColumn("_sy", sy)
        .select(
            *df.columns,
            (F.lit(start[0]) + F.sum("_sx").over(upto)).alias("x"),
            (F.lit(start[1]) + F.sum("_sy").over(upto)).alias("y"),
            normalize_degrees(F.lit(start[2]) + F.sum(do_deg).over(upto)).alias("heading_deg"),
        )
    )


def quaternion(w, x, y, z) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def multiply(a: Column, b: Column) -> Column:
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda p: _product(p["a"], p["b"]))


def _product(a: Column, b: Column) -> Column:
    return quaternion(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def quaternion_from_rpy(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Rotation about x by roll, then about y by yaw, then about z by pitch, as a product."""
    zero = F.lit(0.0)
    about = lambda a, i: quaternion(F.cos(a / 2), *[F.sin(a / 2) if k == i else zero for k in range(3)])
    return multiply(multiply(about(roll, 0), about(yaw, 1)), about(pitch, 2))


def rotation_matrix(q: Column) -> Column:
    """Nine numbers, row by row, of a unit quaternion."""
    return bind(q, _matrix)


def _matrix(q: Column) -> Column:
    w, x, y, z = (q[c] for c in "wxyz")
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def rpy_from_matrix(m: Column) -> Column:
    """(roll, pitch, yaw); yaw is an arc sine and lies in [-pi/2, pi/2]."""
    return bind(m, _rpy)


def _rpy(m: Column) -> Column:
    at = lambda r, c: F.get(m, F.lit(3 * r + c))
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at(0, 2)))
    yaw = F.asin(sine)
    plain = F.abs(F.cos(yaw)) > 1e-8
    roll = F.when(plain, F.atan2(-at(1, 2), at(2, 2))).otherwise(F.atan2(at(2, 1), at(1, 1)))
    pitch = F.when(plain, F.atan2(-at(0, 1), at(0, 0))).otherwise(F.lit(0.0))
    return F.struct(roll.alias("roll"), pitch.alias("pitch"), yaw.alias("yaw"))


def quaternion_from_matrix(m: Column) -> Column:
    """The unit quaternion with w >= 0 of a rotation matrix."""
    return bind(m, _unit_quaternion)


def _unit_quaternion(m: Column) -> Column:
    at = lambda r, c: F.get(m, F.lit(3 * r + c))
    part = lambda s: F.sqrt(F.greatest(F.lit(0.0), s)) / 2
    sign = lambda s: F.when(s < 0, -1.0).otherwise(1.0)
    w = part(1 + at(0, 0) + at(1, 1) + at(2, 2))
    x = part(1 + at(0, 0) - at(1, 1) - at(2, 2)) * sign(at(2, 1) - at(1, 2))
    y = part(1 - at(0, 0) + at(1, 1) - at(2, 2)) * sign(at(0, 2) - at(2, 0))
    z = part(1 - at(0, 0) - at(1, 1) + at(2, 2)) * sign(at(1, 0) - at(0, 1))
    return quaternion(w, x, y, z)


def rotate(q: Column, v: tuple[Column, Column, Column]) -> Column:
    """A vector turned by a unit quaternion."""
    return matrix_vector(rotation_matrix(q), v)


def matrix_vector(m: Column, v: tuple[Column, Column, Column]) -> Column:
    def product(p: Column) -> Column:
        row = lambda r: sum((F.get(p["m"], F.lit(3 * r + c)) * p[f"v{c}"] for c in range(3)), F.lit(0.0))
        return F.struct(row(0).alias("x"), row(1).alias("y"), row(2).alias("z"))

    return bind(F.struct(m.alias("m"), *[x.alias(f"v{i}") for i, x in enumerate(v)]), product)


def camera_matrix(position: Column, q: Column) -> Column:
    """A 4 x 4 pose matrix, row by row, from a place (x, y, z) and a quaternion."""

    def cells(m: Column) -> Column:
        rows = [[F.get(m, F.lit(3 * r + c)) for c in range(3)] + [position[k]] for r, k in enumerate("xyz")]
        return F.array(*[v for row in rows for v in row], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])

    return bind(rotation_matrix(q), cells)


def swap_axes(m: Column) -> Column:
    """A 4 x 4 pose with y up and -z ahead as one with x ahead and z up, and back by symmetry."""
    order, signs = (2, 0, 1, 3), (-1.0, -1.0, 1.0, 1.0)
    at = lambda m, r, c: F.get(m, F.lit(4 * order[r] + order[c])) * signs[r] * signs[c]
    return bind(m, lambda m: F.array(*[at(m, r, c) for r in range(4) for c in range(4)]))


def _vector(*xyz: Column) -> Column:
    return F.struct(*[v.alias(c) for c, v in zip("xyz", xyz, strict=True)])


def _pair(a: Column, b: Column, body) -> Column:
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda p: body(p["a"], p["b"]))


def cross(a: Column, b: Column) -> Column:
    def product(a: Column, b: Column) -> Column:
        return _vector(
            a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"]
        )

    return _pair(a, b, product)


def dot(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda a, b: a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"])


def unit(a: Column) -> Column:
    """At length one; a shorter vector than 1e-8 is divided by that."""
    length = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-8))
    return bind(F.struct(a.alias("a"), length.alias("n")), lambda p: _vector(*[p["a"][c] / p["n"] for c in "xyz"]))


def matrix_from_6d(a: Column, b: Column) -> Column:
    """A rotation's columns from two vectors, the second made orthogonal to the first."""

    def columns(x: Column, z: Column) -> Column:
        return bind(cross(z, x), lambda y: F.array(*[v[c] for c in "xyz" for v in (x, y, z)]))

    return _pair(unit(a), b, lambda x, b: _pair(x, unit(cross(x, b)), columns))


def axis_angle_matrix(axis: Column, angle: Column) -> Column:
    """Rodrigues' formula; angles up to 0.001 give the identity."""

    def cells(a: Column, angle: Column) -> Column:
        x, y, z, s, c = a["x"], a["y"], a["z"], F.sin(angle), F.cos(angle)
        t = 1 - c
        turned = (
            t * x * x + c, t * x * y - s * z, t * x * z + s * y,
            t * x * y + s * z, t * y * y + c, t * y * z - s * x,
            t * x * z - s * y, t * y * z + s * x, t * z * z + c,
        )
        same = F.abs(angle) <= 0.001
        return F.array(*[F.when(same, float(i % 4 == 0)).otherwise(v) for i, v in enumerate(turned)])

    return _pair(unit(axis), angle, cells)


def angle_between(a: Column, b: Column) -> Column:
    """Of two vectors, zero if one has no length."""

    def angle(a: Column, b: Column) -> Column:
        length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return _pair(dot(a, b), length, lambda d, n: F.when(n == 0, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d / n)))))

    return _pair(a, b, angle)


def rotation_between(a: Column, b: Column) -> Column:
    """The matrix that turns a's direction into b's."""
    return _pair(a, b, lambda a, b: axis_angle_matrix(cross(a, b), angle_between(a, b)))


def bearing(from_x: Column, from_z: Column, heading: Column, to_x: Column, to_z: Column) -> Column:
    """Signed angle in the xz plane from a heading to a place."""
    return normalize_radians(F.atan2(to_x - from_x, to_z - from_z) - heading)


def planar_state(position: Column, q: Column) -> Column:
    """(x, y, heading) in the plane of a place (x, y, z) with y up and a quaternion: x ahead along
    -z, y to the left along -x, the heading in (-pi, pi].

    The heading is the middle one of the quaternion's z-y-z angles, or the full turn less it where
    the first of these isn't 0.
    """

    def state(p: Column, q: Column) -> Column:
        first = F.atan2(q["z"], q["w"]) + F.atan2(-q["x"], q["y"])
        length = q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"]
        middle = 2 * F.acos(F.least(F.lit(1.0), F.sqrt((q["w"] * q["w"] + q["z"] * q["z"]) / length)))
        turn = F.pmod(first, F.lit(2 * math.pi))
        still = (turn < 0.1) | (turn > 2 * math.pi - 0.1)
        heading = F.when(still, middle).otherwise(2 * math.pi - middle)
        return F.struct(
            (-p["z"]).alias("x"), (-p["x"]).alias("y"),
            F.when(heading > math.pi, heading - 2 * math.pi).otherwise(heading).alias("heading"),
        )

    return _pair(position, q, state)


def matrix_product(a: Column, b: Column) -> Column:
    """Of two 3 x 3 matrices, row by row."""
    cell = lambda a, b, r, c: sum((F.get(a, F.lit(3 * r + k)) * F.get(b, F.lit(3 * k + c)) for k in range(3)), F.lit(0.0))
    return _pair(a, b, lambda a, b: F.array(*[cell(a, b, r, c) for r in range(3) for c in range(3)]))


def look_at(up_from: Column, ahead_from: Column, up_to: Column, ahead_to: Column) -> Column:
    """The matrix that turns a camera with the first up and viewing direction to the second ones:
    the shortest turn of the viewing direction, then a roll about it."""

    def rolled(first: Column, p: Column) -> Column:
        side = matrix_vector(first, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))

        def roll(side: Column, goal: Column) -> Column:
            angle = angle_between(side, goal)
            flip = dot(p["ahead"], cross(side, goal))
            # near a half turn the direction doesn't matter
            signed = F.when((flip < 0) & (angle < math.pi - 0.001), -angle).otherwise(angle)
            return matrix_product(axis_angle_matrix(p["ahead"], signed), first)

        return _pair(side, unit(cross(p["ahead"], p["up"])), roll)

    goal = F.struct(unit(ahead_to).alias("ahead"), unit(up_to).alias("up"))
    return _pair(rotation_between(unit(ahead_from), unit(ahead_to)), goal, rolled)
