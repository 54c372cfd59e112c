"""Rotations and poses as native expressions over arrays; matrices are row-major.

What has a closed form stays in generated code; conversions with branches are in functions.poses.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajspark.functions.arrays import dot, doubles, group_slice, let, norm


def _at(v: Column, i: int) -> Column:
    return v[i].cast("double")


def _unit(v: Column) -> Column:
    return let(doubles(v), lambda u: let(norm(u), lambda n: F.transform(u, lambda c: c / n)))


def rot6d_to_matrix(r: Column) -> Column:
    """9 elements from the first two rows by Gram-Schmidt; the third row is their cross product."""

    def rows(x: Column, b: Column) -> Column:
        y = let(dot(x, b), lambda d: F.zip_with(b, x, lambda p, q: p - d * q))
        return let(_unit(y), lambda u: F.concat(x, u, F.array(x[1] * u[2] - x[2] * u[1], x[2] * u[0] - x[0] * u[2], x[0] * u[1] - x[1] * u[0])))

    return let(_unit(group_slice(r, 0, 3)), lambda x: let(doubles(group_slice(r, 3, 6)), lambda b: rows(x, b)))


def matrix_to_rot6d(m: Column) -> Column:
    """The first two rows."""
    return group_slice(doubles(m), 0, 6)


def euler_xyz_to_matrix(a: Column, b: Column, c: Column) -> Column:
    """Intrinsic x-y-z rotation by radians: Rx(a) Ry(b) Rz(c)."""
    sa, ca, sb, cb, sc, cc = F.sin(a), F.cos(a), F.sin(b), F.cos(b), F.sin(c), F.cos(c)
    return F.array(cb * cc, -cb * sc, sb, sa * sb * cc + ca * sc, -sa * sb * sc + ca * cc, -sa * cb, -ca * sb * cc + sa * sc, ca * sb * sc + sa * cc, ca * cb)


def matmul3(a: Column, b: list[float] | Column) -> Column:
    """Product of two 3 x 3 matrices; `b` may be a constant."""
    get = (lambda i: F.lit(float(b[i]))) if isinstance(b, list) else (lambda i: _at(b, i))
    return F.array(*[_at(a, 3 * i) * get(j) + _at(a, 3 * i + 1) * get(3 + j) + _at(a, 3 * i + 2) * get(6 + j) for i in range(3) for j in range(3)])


def pose6_to_pose9(p: Column, correction: list[float]) -> Column:
    """(x, y, z, roll, pitch, yaw) to (x, y, z, rot6d) with a fixed correction applied on the right."""
    m = let(euler_xyz_to_matrix(_at(p, 3), _at(p, 4), _at(p, 5)), lambda r: matmul3(r, correction))
    return F.concat(group_slice(doubles(p), 0, 3), matrix_to_rot6d(m))


def quat_to_axis_angle(q: Column) -> Column:
    """Axis times angle of a quaternion (x, y, z, w); w is clipped to [-1, 1], no rotation gives zeros."""
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _at(q, 3)))
    den = F.sqrt(1 - w * w)
    return F.when(F.abs(den) < 1e-9, F.array(*[F.lit(0.0)] * 3)).otherwise(F.array(*[_at(q, i) * 2 * F.acos(w) / den for i in range(3)]))


def wxyz_to_xyzw(q: Column) -> Column:
    return F.concat(group_slice(q, 1, 4), group_slice(q, 0, 1))


def homogeneous(position: Column, rotation: Column) -> Column:
    """16 elements from a position and a 3 x 3 matrix."""
    rows = lambda r: [x for i in range(3) for x in (*[_at(r, 3 * i + j) for j in range(3)], _at(position, i))]
    return let(rotation, lambda r: F.array(*rows(r), *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))


def invert_transform(t: Column) -> Column:
    """Inverse of a rigid transform: transposed rotation, and minus it times the translation."""
    r = [[_at(t, 4 * i + j) for j in range(3)] for i in range(3)]
    p = [_at(t, 4 * i + 3) for i in range(3)]
    out = []
    for i in range(3):
        out += [r[j][i] for j in range(3)] + [-(r[0][i] * p[0] + r[1][i] * p[1] + r[2][i] * p[2])]
    return F.array(*out, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def matmul4(a: Column, b: Column) -> Column:
    return F.array(*[sum((_at(a, 4 * i + k) * _at(b, 4 * k + j) for k in range(1, 4)), _at(a, 4 * i) * _at(b, j)) for i in range(4) for j in range(4)])


def relative_transform(start: Column, t: Column) -> Column:
    """inverse(start) times t."""
    return let(start, lambda s: let(invert_transform(s), lambda i: let(t, lambda x: matmul4(i, x))))


def gripper_sign(x: Column) -> Column:
    """[0, 1] to the sign of 2x - 1."""
    return F.signum(2 * x - 1)


def gripper_threshold(x: Column, at: float = 0.5) -> Column:
    """1 above the threshold, else -1."""
    return F.when(x > at, 1.0).otherwise(-1.0)
