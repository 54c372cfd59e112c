import numpy as np

from trajspark.operators.spikes import implausible

DDL = "dataset_id string, episode_index long, frame_index long, `observation.state` array<float>, action array<float>, dim int"


def _series(n, seed):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    return 40 * np.sin(t / 17 + seed) + r.normal(0, 0.4, n)


def _table(spark, change=None, sizes=((3, 150), (2, 90))):
    rows, e0 = [], 0
    for d, (episodes, n) in zip("ab", sizes):
        for e in range(episodes):
            x = np.stack([_series(n, e0 + e), np.clip(_series(n, e0 + e + 50), 0, 15), np.zeros(n)], 1)
            y = _series(n, e0 + e + 100)[:, None]
            if change:
                change(d, e, x, y)
            rows += [(d, e, i, None if np.isneginf(x[i, 0]) else x[i].tolist(), y[i].tolist(), 7) for i in range(n)]
        e0 += 10
    rows += rows[10:40] * 2  # stored again
    rows += [(None, 1, 1, [9e9, 0.0, 0.0], [0.0], 7), ("a", None, 1, [9e9, 0.0, 0.0], [0.0], 7)]
    return spark.createDataFrame(rows, DDL)


def _found(df):
    return {(r["dataset_id"], r["episode_index"], r["frame_index"], r["field"], r["dim"]): set(r["reasons"]) for r in implausible(df, ["observation.state", "action"]).collect()}


def test_normal_readings_are_no_cases(spark):
    assert _found(_table(spark)) == {}


def test_each_kind_of_case(spark):
    want = {}

    def put(d, e, i, field, k, why):
        want[d, e, i, field, k] = why

    def change(d, e, x, y):
        if (d, e) == ("a", 0):
            x[30, 0] += 35  # within the range, but far from its neighbours
            put(d, e, 30, "observation.state", 0, "excursion")
            x[60:63, 0] -= 300
            for i in (60, 61, 62):
                put(d, e, i, "observation.state", 0, "outside")
            x[90:105, 0] = x[90, 0]
            for i in range(91, 105):
                put(d, e, i, "observation.state", 0, "stuck")
        if (d, e) == ("a", 1):
            y[10, 0] = np.nan
            y[11, 0] = np.inf
            put(d, e, 10, "action", 0, "nonfinite")
            put(d, e, 11, "action", 0, "nonfinite")
            x[149, 0] = 65535  # no reading after it
            put(d, e, 149, "observation.state", 0, "outside")
            x[70, 0] = -np.inf  # stands for a null vector
        if (d, e) == ("b", 1):
            x[20, 1] = 255
            put(d, e, 20, "observation.state", 1, "outside")
            y[40:49, 0] = y[40, 0]  # nine equal readings are too few

    got = _found(_table(spark, change))
    assert got.keys() == want.keys()
    assert all(want[k] in got[k] for k in want)


def test_the_whole_source_says_what_rests_by_habit(spark):
    """A short last piece that is stuck for most of its steps; a dimension that rests everywhere."""

    def change(d, e, x, y):
        x[:, 1] = np.repeat(x[::20, 1], 20)[: len(x)] if d == "a" else x[:, 1]
        if e == 64:
            y[5:25, 0] = y[5, 0]

    got = _found(_table(spark, change, ((65, 40),)))
    assert got == {("a", 64, i, "action", 0): {"stuck"} for i in range(6, 25)}


def test_long_episodes_are_cut_into_blocks_without_a_trace(spark):
    def change(d, e, x, y):
        if e == 0:
            for at in (99, 100, 199, 200):
                x[at, 0] += 300
            x[92:112, 0] = np.where(np.arange(92, 112) >= 101, x[101, 0], x[92:112, 0])

    df = _table(spark, change, ((2, 400),))
    whole = {(r["episode_index"], r["frame_index"], r["field"], r["dim"]) for r in implausible(df, ["observation.state", "action"]).collect()}
    cut = {(r["episode_index"], r["frame_index"], r["field"], r["dim"]) for r in implausible(df, ["observation.state", "action"], block=100).collect()}
    assert whole == cut and len(whole) >= 10


def test_empty_and_single(spark):
    assert implausible(spark.createDataFrame([], DDL), ["observation.state", "action"]).count() == 0
    assert _found(spark.createDataFrame([("a", 0, 0, [1.0], [], 1), ("a", 0, 1, [], None, 1)], DDL)) == {}


def test_stated_limits_hold_whatever_the_source_does(spark):
    rows = [("d", e, i, [float((e * 40 + i) % 7)], [1.0 + (i % 3)]) for e in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "dataset_id string, episode_index long, frame_index long, `observation.state` array<double>, action array<double>")
    assert implausible(df, ["observation.state", "action"]).where("array_contains(reasons, 'impossible')").count() == 0
    got = implausible(df, ["observation.state", "action"], physical={"action": (0.0, 2.5)}).where("array_contains(reasons, 'impossible')").collect()
    assert len(got) == sum(r[4][0] > 2.5 for r in rows) and {r["field"] for r in got} == {"action"}
