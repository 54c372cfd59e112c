"""Pose kernels on NumPy blocks, and Arrow UDFs over them.

Every kernel takes and gives whole batches (n, ...). Rotations: 3 x 3 matrices inside; quaternions
wxyz unless said otherwise; Euler orders in lower case turn about fixed axes, in upper case about
the moving ones; rot6d is the first two rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERS = ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx")
KINDS = ("quat", "euler", "rotvec", "matrix", "rot6d")


def _axis(axis: str, angle: np.ndarray) -> np.ndarray:
    c, s, o, z = np.cos(angle), np.sin(angle), np.ones_like(angle), np.zeros_like(angle)
    rows = {"x": (o, z, z, z, c, -s, z, s, c), "y": (c, z, s, z, o, z, -s, z, c), "z": (c, -s, z, s, c, z, z, z, o)}[axis]
    return np.stack(rows, -1).reshape(*angle.shape, 3, 3)


def euler_to_matrix(e: np.ndarray, order: str = "xyz", degrees: bool = True) -> np.ndarray:
    e = np.asarray(e, float)
    if order.lower() not in ORDERS:
        raise ValueError(f"unknown order {order}")
    e = np.deg2rad(e) if degrees else e
    m = [_axis(a, e[..., i]) for i, a in enumerate(order.lower())]
    return m[0] @ m[1] @ m[2] if order.isupper() else m[2] @ m[1] @ m[0]


def matrix_to_euler(m: np.ndarray, order: str = "xyz", degrees: bool = True) -> np.ndarray:
    """Angles in the order of the axes; in gimbal lock the third of the intrinsic angles is 0."""
    moving = order if order.isupper() else order[::-1].upper()
    i, j, k = ("XYZ".index(a) for a in moving)
    sign = 1.0 if (j - i) % 3 == 1 else -1.0
    s = np.clip(sign * m[..., i, k], -1, 1)
    mid = np.arcsin(s)
    lock = np.abs(s) > 1 - 1e-12
    first = np.where(lock, np.arctan2(sign * m[..., k, j], m[..., j, j]), np.arctan2(-sign * m[..., j, k], m[..., k, k]))
    last = np.where(lock, 0.0, np.arctan2(-sign * m[..., i, j], m[..., i, i]))
    out = np.stack([first, mid, last], -1)
    out = out if order.isupper() else out[..., ::-1]
    return np.rad2deg(out) if degrees else out


def quat_to_matrix(q: np.ndarray, order: str = "wxyz") -> np.ndarray:
    q = np.asarray(q, float)
    q = q if order == "wxyz" else q[..., [3, 0, 1, 2]]
    w, x, y, z = np.moveaxis(q / np.linalg.norm(q, axis=-1, keepdims=True), -1, 0)
    rows = (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))
    return np.stack(rows, -1).reshape(*w.shape, 3, 3)


def matrix_to_quat(m: np.ndarray, order: str = "wxyz") -> np.ndarray:
    """A column of 4 q q', whose entries are sums of the matrix's: that of the largest component, which comes out positive."""
    a, (b, c), (d, e), (f, g) = np.ones(m.shape[:-2]), (m[..., 2, 1], m[..., 1, 2]), (m[..., 0, 2], m[..., 2, 0]), (m[..., 1, 0], m[..., 0, 1])
    x, y, z = m[..., 0, 0], m[..., 1, 1], m[..., 2, 2]
    outer = np.stack([a + x + y + z, b - c, d - e, f - g, b - c, a + x - y - z, f + g, d + e, d - e, f + g, a - x + y - z, b + c, f - g, d + e, b + c, a - x - y + z], -1).reshape(*m.shape[:-2], 4, 4)
    pick = np.argmax(np.diagonal(outer, axis1=-2, axis2=-1), -1)
    q = np.take_along_axis(outer, pick[..., None, None], -2)[..., 0, :]
    q = q / np.linalg.norm(q, axis=-1, keepdims=True)
    return q if order == "wxyz" else q[..., [1, 2, 3, 0]]


def rotvec_to_matrix(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, float)
    angle = np.linalg.norm(v, axis=-1)
    half = np.where(angle < 1e-8, 0.5 - angle**2 / 48, np.sin(angle / 2) / np.where(angle < 1e-8, 1, angle))
    return quat_to_matrix(np.concatenate([np.cos(angle / 2)[..., None], v * half[..., None]], -1))


def matrix_to_rotvec(m: np.ndarray) -> np.ndarray:
    q = matrix_to_quat(m)
    q = np.where(q[..., :1] < 0, -q, q)
    n = np.linalg.norm(q[..., 1:], axis=-1)
    angle = 2 * np.arctan2(n, q[..., 0])
    scale = np.where(n < 1e-9, 2 + angle**2 / 12, angle / np.where(n < 1e-9, 1, n))
    return q[..., 1:] * scale[..., None]


def rot6d_to_matrix(r: np.ndarray) -> np.ndarray:
    r = np.asarray(r, float)
    x = r[..., :3] / np.linalg.norm(r[..., :3], axis=-1, keepdims=True)
    y = r[..., 3:6] - (x * r[..., 3:6]).sum(-1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=-1, keepdims=True)
    return np.stack([x, y, np.cross(x, y)], -2)


def to_matrix(x: np.ndarray, kind: str, order: str | None = None, degrees: bool = True) -> np.ndarray:
    x = np.asarray(x, float)
    if kind == "quat":
        return quat_to_matrix(x, order or "wxyz")
    if kind == "euler":
        return euler_to_matrix(x, order or "xyz", degrees)
    if kind == "rotvec":
        return rotvec_to_matrix(x)
    if kind == "rot6d":
        return rot6d_to_matrix(x)
    if kind == "matrix":
        return x.reshape(*x.shape[:-1], 3, 3) if x.shape[-1] == 9 else x
    raise ValueError(f"unknown rotation {kind}")


def from_matrix(m: np.ndarray, kind: str, order: str | None = None, degrees: bool = True) -> np.ndarray:
    flat = m.reshape(*m.shape[:-2], 9)
    if kind == "quat":
        return matrix_to_quat(m, order or "wxyz")
    if kind == "euler":
        return matrix_to_euler(m, order or "xyz", degrees)
    if kind == "rotvec":
        return matrix_to_rotvec(m)
    if kind == "rot6d":
        return flat[..., :6]
    if kind == "matrix":
        return flat
    raise ValueError(f"unknown rotation {kind}")


def compose(position: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    t = np.zeros((*rotation.shape[:-2], 4, 4))
    t[..., :3, :3], t[..., :3, 3], t[..., 3, 3] = rotation, position, 1
    return t


def invert(t: np.ndarray) -> np.ndarray:
    r = np.swapaxes(t[..., :3, :3], -1, -2)
    return compose(-(r @ t[..., :3, 3:])[..., 0], r)


def relative(start: np.ndarray, t: np.ndarray) -> np.ndarray:
    return invert(start) @ t


def read_pose(x: np.ndarray, form: str) -> np.ndarray:
    """Transforms from rows by format: rot6d (9 numbers), rotvec (6) or homogeneous (16)."""
    x = np.asarray(x, float)
    if form == "homogeneous":
        return x.reshape(*x.shape[:-1], 4, 4)
    if form not in ("rot6d", "rotvec"):
        raise ValueError(f"unknown format {form}")
    return compose(x[..., :3], to_matrix(x[..., 3:], form))


def write_pose(t: np.ndarray, form: str) -> np.ndarray:
    if form == "homogeneous":
        return t.reshape(*t.shape[:-2], 16)
    return np.concatenate([t[..., :3, 3], from_matrix(t[..., :3, :3], form)], -1)


def slerp(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Between rotation matrices along the shorter arc."""
    step = matrix_to_rotvec(np.swapaxes(a, -1, -2) @ b)
    return a @ rotvec_to_matrix(step * np.asarray(t, float)[..., None])


def interpolate_poses(poses: np.ndarray, times: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Transforms at the times `at`: positions linearly, rotations by slerp. Out of range is an error.

    Readings whose time does not pass that of the original reading before are dropped first.
    """
    keep = np.r_[True, times[1:] > times[:-1]]
    poses, times = poses[keep], np.asarray(times, float)[keep]
    if len(times) < 2:
        raise ValueError("at least two poses are needed")
    if at.min() < times[0] - 1e-12 or at.max() > times[-1] + 1e-12:
        raise ValueError("a time lies outside the poses")
    i = np.clip(np.searchsorted(times, at, side="right") - 1, 0, len(times) - 2)
    f = (at - times[i]) / (times[i + 1] - times[i])
    p = poses[i, :3, 3] + (poses[i + 1, :3, 3] - poses[i, :3, 3]) * f[:, None]
    return compose(p, slerp(poses[i, :3, :3], poses[i + 1, :3, :3], f))


def _rows(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in s]) if len(s) else np.zeros((0, 16))


def _udf(f, *cols: Column) -> Column:
    """An Arrow UDF over vectors; a row with a null argument gives null."""

    @F.pandas_udf("array<double>")
    def run(*xs: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(xs[0]), dtype=object)
        ok = np.logical_and.reduce([x.notna().to_numpy() for x in xs])
        if ok.any():
            got = f(*[_rows(x[ok]) for x in xs])
            out[ok] = pd.Series(list(got), index=out.index[ok])
        return out

    return run(*cols)


def convert_rotation(v: Column, source: str, target: str, source_order: str | None = None, target_order: str | None = None, degrees: bool = True) -> Column:
    return _udf(lambda x: from_matrix(to_matrix(x, source, source_order, degrees), target, target_order, degrees), v)


def convert_pose(v: Column, source: str, target: str) -> Column:
    return _udf(lambda x: write_pose(read_pose(x, source), target), v)


def relative_pose(start: Column, v: Column, form: str, target: str = "homogeneous") -> Column:
    return _udf(lambda a, b: write_pose(relative(read_pose(a, form), read_pose(b, form)), target), start, v)


def absolute_pose(start: Column, v: Column, form: str, relative_form: str = "homogeneous") -> Column:
    """The inverse of relative_pose: start times the relative transform, in `form`."""
    return _udf(lambda a, b: write_pose(read_pose(a, form) @ read_pose(b, relative_form), form), start, v)


def slerp_pose(a: Column, b: Column, t: Column, form: str) -> Column:
    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series, f: pd.Series) -> pd.Series:
        p, q, f = read_pose(_rows(x), form), read_pose(_rows(y), form), f.to_numpy(float)
        if not len(f):
            return pd.Series([], dtype=object)
        pos = p[:, :3, 3] + (q[:, :3, 3] - p[:, :3, 3]) * f[:, None]
        return pd.Series(list(write_pose(compose(pos, slerp(p[:, :3, :3], q[:, :3, :3], f)), form)))

    return run(a, b, t)
