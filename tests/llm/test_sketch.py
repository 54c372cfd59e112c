import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from trajspark.llm import percentiles
from trajspark.llm.sketch import QuantileSketch


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), max_size=300), min_size=1, max_size=8), st.integers(2, 16), st.integers(2, 5), st.sampled_from([0.0, 0.01, 0.5, 0.99, 1.0]))
def test_bounds_hold_after_merges(parts, size, buffers, q):
    sketches = [QuantileSketch(size, buffers).add(np.array(p, float)) for p in parts]
    s = QuantileSketch.load(sketches[0].dump())
    for x in sketches[1:]:
        s.merge(QuantileSketch.load(x.dump()))
    values = np.concatenate([np.array(p, float) for p in parts])
    assert s.n == len(values)
    mid, least, most = s.quantile(q)
    if not len(values):
        assert mid != mid
        return
    exact = np.quantile(values, q)
    assert least <= exact + 1e-9 and exact - 1e-9 <= most
    assert sum(w * len(v) for _, w, v in s.full) + sum(map(len, s.part)) == s.n


def test_error_is_small_for_many_values():
    x = np.random.default_rng(1).normal(size=300_000)
    s = QuantileSketch(2048, 8)
    for part in np.array_split(x, 7):
        s.add(part)
    assert s.slack / s.n < 0.004
    for q in (0.01, 0.5, 0.99):
        rank = (np.sort(x) < s.quantile(q)[0]).mean()
        assert abs(rank - q) < 0.002


def test_not_finite_values_are_left_out():
    s = QuantileSketch(4, 2).add(np.array([np.nan, np.inf, 1.0, -np.inf]))
    assert s.n == 1 and s.quantile(0.99) == (1.0, 1.0, 1.0)


FRAMES = "dataset_id string, episode_index long, frame_index long, `observation.state` array<float>, action array<float>, extra int"
STATS = "dataset_id string, modality string, key string, step int, dim int, q01 double, q99 double"
MODALITY = "dataset_id string, modality string, key string, start int, end int, original_key string"


def _tables(spark, n=400):
    rng = np.random.default_rng(3)
    rows = []
    for e in range(4):
        for f in range(n // 4):
            s = [float(x) for x in rng.normal(size=3).astype(np.float32)]
            a = [float(x) for x in rng.normal(size=2).astype(np.float32)]
            rows.append(("d", e, f, s, a, 1))
    rows += rows[:50]  # stored again
    rows += [("d", 9, 0, None, None, 1), ("d", 9, 1, [float("nan"), None, 1.0], [2.0, 3.0], 1), (None, 1, 1, [1.0], [1.0], 1)]
    mod = [("d", "state", "single_arm", 0, 2, "observation.state"), ("d", "action", "single_arm", 0, 2, "action")]
    return rows, mod


def _actual(rows):
    seen = {(r[0], r[1], r[2]): r for r in rows if r[0]}
    out = {}
    for (_, e, f), r in seen.items():
        for key, v in (("observation.state", r[3]), ("action", r[4])):
            for d, x in enumerate(v or []):
                if x is not None and np.isfinite(x):
                    out.setdefault(("stats", key, -1, d), []).append(x)
        for h in (0, 5):
            g = seen.get(("d", e, f + h))
            if g and g[4] and r[3]:
                for d in range(2):
                    if r[3][d] is not None and np.isfinite(r[3][d]):
                        out.setdefault(("relative_stats", "single_arm", h, d), []).append(np.float64(g[4][d]) - np.float64(r[3][d]))
    return {k: np.quantile(v, [0.01, 0.99]) for k, v in out.items()}


def _check(spark, rows, mod, sizes=percentiles.Sizes()):
    actual = _actual(rows)
    stats = []
    for i, ((m, k, h, d), (a, b)) in enumerate(sorted(actual.items())):
        off = (0.0, 0.04, 0.06, 0.5)[i % 4] * (b - a)
        stats.append(("d", m, k, None if h < 0 else h, d, float(a + off), None if i % 3 == 0 else float(b - off)))
    want = {(m, k, h, d, bound) for i, (m, k, h, d) in enumerate(sorted(actual)) if i % 4 > 1 for bound in ("q01", "q99") if not (bound == "q99" and i % 3 == 0)}
    f, s, o = (spark.createDataFrame(r, t) for r, t in ((rows, FRAMES), (stats, STATS), (mod, MODALITY)))
    got = {tuple(r)[1:] for r in percentiles.wrong_percentiles(f, s, o, sizes=sizes).collect()}
    assert got == want
    return f, s, o, actual


def test_published_values_against_numpy(spark):
    rows, mod = _tables(spark)
    f, s, o, actual = _check(spark, rows, mod)
    got = {(r["modality"], r["key"], r["step"], r["dim"]): (r["q01"], r["q99"]) for r in percentiles.percentiles(f, s, o).collect()}
    assert got.keys() == actual.keys()
    for k, v in actual.items():
        np.testing.assert_allclose(got[k], v)


def test_large_sources_go_through_merged_sketches_and_exact_selection(spark):
    rows, mod = _tables(spark)  # episodes are cut by the blocks, relative readings cross the cuts
    _check(spark, rows, mod, percentiles.Sizes(size=16, buffers=3, block=40))


def test_empty_tables(spark):
    f, s, o = (spark.createDataFrame([], t) for t in (FRAMES, STATS, MODALITY))
    assert percentiles.wrong_percentiles(f, s, o).count() == 0
    assert percentiles.percentiles(f, s, o).count() == 0
