import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions import poses, rotations

R = np.random.default_rng(7)


def _matrices(n=200):
    return poses.quat_to_matrix(R.normal(size=(n, 4)))


@pytest.mark.parametrize("kind,order", [("quat", "wxyz"), ("quat", "xyzw"), ("rotvec", None), ("matrix", None), ("rot6d", None)] + [("euler", o) for p in poses.ORDERS for o in (p, p.upper())])
def test_round_trips(kind, order):
    m = _matrices()
    np.testing.assert_allclose(poses.to_matrix(poses.from_matrix(m, kind, order), kind, order), m, atol=1e-9)


def test_orthonormal_and_directions():
    m = _matrices()
    np.testing.assert_allclose(m @ np.swapaxes(m, -1, -2), np.broadcast_to(np.eye(3), m.shape), atol=1e-12)
    quarter = poses.euler_to_matrix(np.array([0, 0, 90.0]), "xyz")
    np.testing.assert_allclose(quarter @ [1, 0, 0], [0, 1, 0], atol=1e-12)
    e = np.array([10.0, 20.0, 30.0])
    x, y, z = (poses._axis(a, np.deg2rad(v)) for a, v in zip("xyz", e))
    np.testing.assert_allclose(poses.euler_to_matrix(e, "xyz"), z @ y @ x, atol=1e-12)
    np.testing.assert_allclose(poses.euler_to_matrix(e, "XYZ"), x @ y @ z, atol=1e-12)
    np.testing.assert_allclose(poses.rotvec_to_matrix(np.array([0, 0, np.pi / 2])), quarter, atol=1e-12)


@pytest.mark.parametrize("order", [o for p in poses.ORDERS for o in (p, p.upper())])
def test_gimbal_lock(order):
    for mid in (90.0, -90.0):
        m = poses.euler_to_matrix(np.array([[20.0, mid, 35.0]]), order)
        np.testing.assert_allclose(poses.euler_to_matrix(poses.matrix_to_euler(m, order), order), m, atol=1e-7)


def test_half_turns():
    for axis in np.eye(3):
        m = poses.rotvec_to_matrix(np.pi * axis)[None]
        np.testing.assert_allclose(poses.quat_to_matrix(poses.matrix_to_quat(m)), m, atol=1e-12)
        np.testing.assert_allclose(np.abs(poses.matrix_to_rotvec(m)[0]), np.pi * axis, atol=1e-6)
    assert np.allclose(poses.matrix_to_rotvec(np.eye(3)[None]), 0)


@pytest.mark.parametrize("form,width", [("rot6d", 9), ("rotvec", 6), ("homogeneous", 16)])
def test_pose_formats_and_relatives(form, width):
    t = poses.compose(R.normal(size=(50, 3)), _matrices(50))
    rows = poses.write_pose(t, form)
    assert rows.shape == (50, width)
    np.testing.assert_allclose(poses.read_pose(rows, form), t, atol=1e-9)
    rel = poses.relative(t[:1], t)
    np.testing.assert_allclose(rel[0], np.eye(4), atol=1e-12)
    np.testing.assert_allclose(t[:1] @ rel, t, atol=1e-9)
    np.testing.assert_allclose(poses.invert(t) @ t, np.broadcast_to(np.eye(4), t.shape), atol=1e-9)


def test_slerp():
    a, b = _matrices(2)
    np.testing.assert_allclose(poses.slerp(a[None], b[None], np.array([0.0]))[0], a, atol=1e-9)
    np.testing.assert_allclose(poses.slerp(a[None], b[None], np.array([1.0]))[0], b, atol=1e-9)
    half = poses.slerp(np.eye(3)[None], poses.euler_to_matrix(np.array([[0, 0, 90.0]])), np.array([0.5]))
    np.testing.assert_allclose(poses.matrix_to_euler(half), [[0, 0, 45]], atol=1e-9)
    t = poses.compose(np.array([[0.0, 0, 0], [9, 9, 9], [2, 0, 0]]), np.stack([np.eye(3), a, half[0]]))
    got = poses.interpolate_poses(t, np.array([0.0, 0.0, 1.0]), np.array([0.0, 0.5, 1.0]))  # the stalled reading is dropped
    np.testing.assert_allclose(got[:, 0, 3], [0, 1, 2])
    with pytest.raises(ValueError):
        poses.interpolate_poses(t, np.array([0.0, 0.5, 1.0]), np.array([2.0]))
    with pytest.raises(ValueError):
        poses.interpolate_poses(t[:2], np.array([0.0, 0.0]), np.array([0.0]))


def test_native_expressions_match_the_kernels(spark):
    v = R.normal(size=(40, 9))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(v, np.roll(v, 1, 0))], "p array<double>, q array<double>")
    native = lambda c: rotations.homogeneous(F.slice(c, 1, 3), rotations.rot6d_to_matrix(F.slice(c, 4, 6)))
    got = df.select(rotations.relative_transform(native(F.col("q")), native(F.col("p"))).alias("a"), poses.relative_pose(F.col("q"), F.col("p"), "rot6d").alias("b"), rotations.quat_to_axis_angle(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])).alias("z")).collect()
    np.testing.assert_allclose([r["a"] for r in got], [r["b"] for r in got], atol=1e-9)
    assert got[0]["z"] == [0.0, 0.0, 0.0]
    back = df.select(poses.absolute_pose(F.col("q"), poses.relative_pose(F.col("q"), F.col("p"), "rot6d"), "rot6d").alias("x"), poses.convert_pose(F.col("p"), "rot6d", "rot6d").alias("y")).collect()
    np.testing.assert_allclose([r["x"] for r in back], [r["y"] for r in back], atol=1e-9)


def test_null_vectors(spark):
    df = spark.createDataFrame([(None,), ([1.0, 0.0, 0.0, 0.0, 1.0, 0.0],)], "r array<double>")
    got = [r[0] for r in df.select(poses.convert_rotation(F.col("r"), "rot6d", "quat")).collect()]
    assert got[0] is None and got[1] == [1.0, 0.0, 0.0, 0.0]
