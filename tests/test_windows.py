import math

import pytest
from pyspark.sql import functions as F

from trajspark.functions import arrays, normalize
from trajspark.operators import windows


def _seq(spark, values, key="k"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "k string, i int, x double")


def _chunks(df, deltas, boundary):
    return {r["i"]: r["chunk"] for r in windows.offsets(df, ["k"], "i", "x", deltas, boundary).collect()}


def test_boundaries(spark):
    df = _seq(spark, [0.0, 1.0, 2.0, 3.0, 4.0])
    assert _chunks(df, [-2, 0, 2], "clamp")[0] == [0.0, 0.0, 2.0]
    assert _chunks(df, [-2, 0, 2], "clamp")[4] == [2.0, 4.0, 4.0]
    assert _chunks(df, [-2, 0], "wrap")[0] == [3.0, 0.0]
    assert sorted(_chunks(df, [-2, 1], "wrap")) == [0, 1, 2, 3]  # beyond the end there is nothing to wrap to
    assert sorted(_chunks(df, [0, 3], "drop")) == [0, 1]
    with pytest.raises(Exception, match="beyond the sequence"):
        _chunks(df, [0, 1], "error")
    with pytest.raises(ValueError):
        windows.offsets(df, ["k"], "i", "x", [0], "mirror")


def test_nulls_keep_their_place(spark):
    df = _seq(spark, [0.0, None, 2.0])
    assert _chunks(df, [0, 1], "drop") == {0: [0.0, None], 1: [None, 2.0]}
    assert _chunks(df, [-1, 1], "clamp") == {0: [0.0, None], 1: [0.0, 2.0], 2: [None, 2.0]}


def test_usable_steps(spark):
    df = spark.createDataFrame([(50,), (7,), (8,)], "n int")
    assert [r[0] for r in df.select(windows.usable(F.col("n"), list(range(8)))).collect()] == [43, 0, 1]


def test_replay_pads_with_the_last(spark):
    got = {r["i"]: r["chunk"] for r in windows.replay(_seq(spark, [0.0, 1.0, 2.0, 3.0, 4.0]), ["k"], "i", "x", 4, 3).collect()}
    assert got == {0: [0.0, 1.0, 2.0, 3.0], 3: [3.0, 4.0, 4.0, 4.0]}


def test_delta_and_back(spark):
    df = spark.createDataFrame([([[1.0], [3.0], [6.0]],)], "c array<array<double>>")
    one = df.select(windows.delta_chunk(F.col("c")), windows.delta_chunk(F.col("c"), F.array(F.lit(0.0))), windows.relative_chunk(F.col("c")), windows.absolute_chunk(windows.relative_chunk(F.col("c"), F.array(F.lit(5.0))), F.array(F.lit(5.0)))).first()
    assert list(one) == [[[0.0], [2.0], [3.0]], [[1.0], [2.0], [3.0]], [[0.0], [2.0], [5.0]], [[1.0], [3.0], [6.0]]]
    with pytest.raises(Exception, match="differ in length"):
        df.select(arrays.minus(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


def test_resample(spark):
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate([0.0, 0.1, 0.35])], "k string, i int, t double")
    got = sorted((r["slot"], r["i"]) for r in windows.resample(df, ["k"], "t", "i", F.lit(0.0), 0.1).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 2)]
    none = sorted((r["slot"], r["i"]) for r in windows.resample(df, ["k"], "t", "i", F.lit(-0.2), 0.1, first=None).collect())
    assert none == [(2, 0), (3, 1), (4, 2), (5, 2)]
    assert windows.resample(df, ["k"], "t", "i", F.lit(9.0), 0.1).count() == 0


def test_nearest_and_interpolation(spark):
    df = spark.createDataFrame([("k", 0, 0.0, 1.0), ("k", 1, 1.0, 3.0), ("k", 2, 1.0, 9.0), ("k", 3, 4.0, 6.0)], "k string, i int, t double, x double")
    q = spark.createDataFrame([("k", 0.5), ("k", 0.6), ("k", 2.5), ("k", 99.0), ("k", -1.0), ("none", 1.0)], "k string, at double")
    got = {(r["k"], r["at"]): r["i"] for r in windows.nearest(df, ["k"], "t", "i", q, "at").collect()}
    assert got == {("k", 0.5): 0, ("k", 0.6): 1, ("k", 2.5): 1, ("k", 99.0): 3, ("k", -1.0): 0, ("none", 1.0): None}
    m = windows.monotonic(df, ["k"], "i", "t")
    assert [r["i"] for r in m.orderBy("i").collect()] == [0, 1, 3]
    v = {r["at"]: r["value"] for r in windows.interpolate(m, ["k"], "t", "x", q.where("k = 'k'"), "at").collect()}
    assert v == {0.5: 2.0, 0.6: pytest.approx(2.2), 2.5: 4.5, 99.0: None, -1.0: None}


def test_ensemble_weights(spark):
    df = spark.createDataFrame([("k", i, [[float(10 * i + j), float(j)] for j in range(3)]) for i in range(3)], "k string, i int, p array<array<double>>")
    got = {r["step"]: r["vector"] for r in windows.ensemble(df, ["k"], "i", "p", 3, most=2, newest=[1]).collect()}
    w = math.exp(0.005)
    assert got[0] == [0.0, 0.0]
    assert got[1][0] == pytest.approx((1 + w * 10) / (1 + w)) and got[1][1] == 0.0
    assert got[2][0] == pytest.approx((11 + w * 20) / (1 + w))


def test_latch_and_sessions(spark):
    df = _seq(spark, [0.5, 0.9, 0.1, 0.1, 0.5, 0.5])
    got = [r["latched"] for r in windows.latched(df, ["k"], "i", "x", 3).orderBy("i").collect()]
    assert got == [0.0, pytest.approx(-0.8), pytest.approx(-0.8), pytest.approx(-0.8), 0.0, 0.0]
    runs = [r["run"] for r in windows.sessions(_seq(spark, [0.0, 1.0, 0.0, 1.0, 0.0]).withColumn("d", F.col("x") > 0), ["k"], "i", "d").orderBy("i").collect()]
    assert runs == [0, 0, 1, 1, 2]


def test_normalization(spark):
    df = spark.createDataFrame([([0.0, 5.0, 7.0], [0.0, 0.0, 7.0], [10.0, 10.0, 7.0])], "v array<double>, lo array<double>, hi array<double>")
    v, lo, hi = (F.col(c) for c in ("v", "lo", "hi"))
    assert df.select(normalize.minmax(v, lo, hi)).first()[0] == [-1.0, 0.0, 0.0]
    three = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert df.select(normalize.unminmax(three(-1, 0, 3), three(0, 0, 0), three(10, 10, 10))).first()[0] == [0.0, 5.0, 10.0]
    assert df.select(normalize.unminmax(three(1), three(7), three(7))).first()[0] == [7.0]
    assert df.select(normalize.meanstd(three(4, 4), three(1, 2), three(0, 2))).first()[0] == [4.0, 1.0]
    assert df.select(normalize.state(three(9), "meanstd", {"mean": three(1), "std": three(2)})).first()[0] == [4.0]  # states pass unclipped
    assert df.select(normalize.action(three(9), "meanstd", {"mean": three(1), "std": three(2)})).first()[0] == [1.0]
    assert df.select(arrays.sin_cos(three(0))).first()[0] == [0.0, 1.0]
    nan = df.select(arrays.clip(F.lit(float("nan"))), arrays.clip(F.lit(7.0))).first()
    assert math.isnan(nan[0]) and nan[1] == 1.0
    with pytest.raises(ValueError):
        normalize.unstate(v, "sincos", {})
    stats = {"a": {"min": 0, "max": 9, "q01": 1, "q99": 8}}
    assert normalize.parameters(stats, ["a"], percentiles=True)["a"]["min"] == 1
    assert normalize.parameters(stats, ["a"], {"a": {"min": -5, "max": 5}}, percentiles=True)["a"] == {"min": -5, "max": 5}
    with pytest.raises(KeyError):
        normalize.parameters(stats, ["b"])
    assert normalize.install({"a": 1}, {"a": 2, "b": 3}) == ({"a": 1, "b": 3}, ["a"])
    assert normalize.install({"a": 1}, {"a": 2}, override=True) == ({"a": 2}, [])


def test_padding(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(arrays.pad_right(F.col("v"), 3)).collect()] == [[1.0, 2.0, 0.0], [0.0, 0.0, 0.0]]
    assert [r[0] for r in df.select(arrays.pad_mask(F.col("v"), 3)).collect()] == [[1, 1, 0], [0, 0, 0]]
    with pytest.raises(Exception, match="at most 1"):
        df.select(arrays.pad_right(F.col("v"), 1)).collect()
    assert [r[0] for r in df.select(arrays.take_last(F.col("v"), 5)).collect()] == [[1.0, 2.0], []]
    assert df.select(arrays.group_slice(F.col("v"), 1, 9)).first()[0] == [2.0]
    assert df.select(arrays.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] == 0.0
