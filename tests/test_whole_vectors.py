"""Queries over whole vectors against brute force, on the smallest data."""

from collections import defaultdict

import numpy as np
import pytest

from trajspark import catalog


def _episodes(spark, data):
    seen = {}
    for r in spark.read.parquet(f"{data}/frames.parquet").select("dataset_id", "episode_index", "frame_index", "`observation.state`", "action").collect():
        if None not in r[:3]:
            seen[r[:3]] = [None if v is None else np.array([np.nan if x is None else x for x in v], float) for v in r[3:]]
    out = defaultdict(list)
    for k in sorted(seen):
        out[k[:2]].append((k[2], *seen[k]))
    return out


def _less(v, ref):
    """Over the dimensions that both have."""
    n = min(len(v), len(ref))
    with np.errstate(all="ignore"):
        return v[:n] - ref[:n]


@pytest.mark.parametrize("name", ["relative_chunk", "delta_chunk", "absolute_chunk"])
def test_chunks_of_all_dimensions(spark, data, name):
    want = defaultdict(list)
    for ep, rows in _episodes(spark, data).items():
        rows = [r for r in rows if r[1] is not None and r[2] is not None]
        for i, (_, ref, _) in enumerate(rows):
            if name == "absolute_chunk" and not np.isfinite(ref).all():
                continue
            was = ref
            for k, (_, _, v) in enumerate(rows[i : i + 4]):
                x = {"relative_chunk": _less(v, ref), "delta_chunk": _less(v, was), "absolute_chunk": v[: len(ref)]}[name]
                was = v
                for d in np.flatnonzero(np.isfinite(x) & (np.abs(x) < 1e30)):
                    want[*ep, k, int(d)].append(x[d])
    got = {tuple(r[:4]): (r["total"], r["n"]) for r in catalog.queries()[name](spark, data).collect()}
    assert got.keys() == want.keys() and max(k[3] for k in want) > 4
    assert all(got[k][1] == len(v) and abs(got[k][0] - sum(v)) < 0.01 + 1e-6 * sum(map(abs, v)) for k, v in want.items())


def test_relative_statistics_of_all_dimensions(spark, data):
    want = defaultdict(list)
    for ep, rows in _episodes(spark, data).items():
        for i, (frame, ref, action) in enumerate(rows):
            if frame < len(rows) - 3 and ref is not None and action is not None:
                for h, (_, _, v) in enumerate(rows[i : i + 4]):
                    if v is not None:
                        x = _less(v, ref)
                        for d in np.flatnonzero(np.isfinite(x)):
                            want[ep[0], h, int(d)].append(x[d])
    got = {tuple(r[:3]): r for r in catalog.queries()["stats_relative_chunk"](spark, data).collect()}
    assert got.keys() == want.keys() and max(k[2] for k in want) > 4
    for k, v in want.items():
        exact = (np.mean(v), np.std(v), min(v), max(v), *np.quantile(v, [0.01, 0.99]))
        assert np.allclose([got[k][c] for c in ("mean", "std", "min", "max", "q01", "q99")], exact, rtol=1e-6, atol=1e-3), k


def test_every_vector_is_in_a_chunk(spark, data):
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect():
        labels[r["label"]].append(r["embedding"])
    want = {}
    for label, vs in labels.items():
        for i, v in enumerate(vs):
            want[label, i // 5, i % 5] = sum(v)
    rows = catalog.queries()["horizon_mask"](spark, data).collect()
    got = {(r["label"], r["chunk"], r["step"]): r["total"] for r in rows if r["mask"]}
    assert got.keys() == want.keys() and all(abs(got[k] - x) < 1e-3 for k, x in want.items())
    assert all(r["total"] == 0 for r in rows if not r["mask"])
    assert catalog.queries()["state_dropout"](spark, data).select("dim").distinct().count() == 64


def test_bins_bound_and_select_percentiles(spark):
    from trajspark.operators import stats

    r = np.random.default_rng(5)
    rows = [(f"k{i % 3}", [float(x) for x in r.normal(size=2) * 10.0 ** r.integers(-3, 4)] + [0.0, -0.0 if i % 2 else 0.0]) for i in range(3000)]
    df = spark.createDataFrame(rows + [("k0", [None, float("nan")]), ("k9", None), ("k1", [float("inf")])], "k string, v array<double>").repartition(7)
    exact = {(x["k"], x["dim"]): x for x in stats.vector_statistics(df, ["k"], ["v"]).collect()}
    near = {(x["k"], x["dim"]): x for x in stats.vector_statistics(df, ["k"], ["v"], exact=False).collect()}
    assert len(exact) == len(near) == 12
    for k in range(3):
        for d in range(4):
            v = np.array([x[1][d] for x in rows if x[0] == f"k{k}"])
            got, bound = exact[f"k{k}", d], near[f"k{k}", d]
            np.testing.assert_allclose([got[c] for c in stats.SIX], [v.mean(), v.std(), v.min(), v.max(), *np.quantile(v, [0.01, 0.99])], rtol=1e-9, atol=1e-9)
            for q in ("q01", "q99"):
                assert bound[f"{q}_least"] <= got[q] <= bound[f"{q}_most"]
                assert bound[f"{q}_most"] - bound[f"{q}_least"] <= abs(got[q]) / 10 + 1e-3 or len(v) < 50 or abs(got[q]) > 100
