import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import evaluation, maintenance, sampling, stats
from trajspark.plans import modalities as m


def test_against_numpy(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 3)).astype(np.float32)
    df = spark.createDataFrame([("k", [float(x) for x in row], float(row[0])) for row in v] + [("k", None, None), ("k", [float("nan")], 1e400)], "k string, v array<float>, s double")
    got = stats.to_tree(stats.vector_statistics(df, [], ["v", "s"]).collect())
    for name, f in (("mean", np.mean), ("std", np.std), ("min", np.min), ("max", np.max)):
        np.testing.assert_allclose(got["v"][name], f(v.astype(float), axis=0), rtol=1e-6)
    np.testing.assert_allclose(got["v"]["q01"], np.quantile(v.astype(float), 0.01, axis=0), rtol=1e-6)
    assert len(got["s"]["q99"]) == 1
    for s in got.values():
        assert all(lo <= a <= b <= hi and d >= 0 for lo, a, b, hi, d in zip(s["min"], s["q01"], s["q99"], s["max"], s["std"]))
    assert stats.vector_statistics(df.where("false"), [], ["v"]).count() == 0


def test_merging(spark):
    ddl = "k string, w double, mean double, std double, min double, max double, q01 double, q99 double"
    df = spark.createDataFrame([("a", 3.0, 0.0, 0.0, -1.0, 1.0, -0.5, 0.5), ("a", 1.0, 2.0, 0.0, 0.0, 5.0, 0.1, 4.0), ("a", 9.0, None, 1.0, -99.0, 99.0, 0.0, 0.0), ("b", 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0), ("b", 1.0, 1.0, 1.0, 0.0, 2.0, 0.0, 1.0)], ddl)
    got = {r["k"]: r for r in stats.merge_weighted(df, ["k"], "w").collect()}
    assert (got["a"]["mean"], got["a"]["min"], got["a"]["max"], got["a"]["q01"], got["a"]["q99"]) == (0.5, -1.0, 5.0, -0.5, 4.0)
    assert got["a"]["std"] == pytest.approx(np.sqrt(1 - 0.25)) and got["b"]["mean"] == 0.5 and got["b"]["max"] == 2.0


def test_cache(tmp_path):
    path = str(tmp_path / "stats.json")
    cache, calls = stats.StatsCache(path), []
    full = {s: [0.0] for s in stats.SIX}

    def compute(names):
        calls.append(sorted(names))
        return {n: full for n in names}

    specs = {"a": {"dtype": "float32", "shape": [2]}, "b": {"dtype": "float64", "shape": [1]}}
    assert cache.refresh(specs, compute) == ["a", "b"] and calls == [["a", "b"]]
    before = os.stat(path).st_mtime_ns
    assert cache.refresh(specs, compute) == [] and os.stat(path).st_mtime_ns == before
    specs["b"]["shape"] = [3]
    assert cache.refresh(specs, compute) == ["b"]
    data = json.load(open(path))
    data["foreign"] = 1
    data["a"].pop("q01")
    json.dump(data, open(path, "w"))
    assert cache.refresh(specs, compute) == ["a"] and json.load(open(path))["foreign"] == 1
    assert cache.refresh({"a": specs["a"]}, compute) == [] and "b" not in json.load(open(path))
    for broken in ("", '{"a": ', "[1]", "junk"):
        open(path, "w").write(broken)
        assert stats.read_json(path) == {}
    assert stats.read_json(str(tmp_path / "none.json")) == {} and cache.refresh(specs, compute) == ["a", "b"]
    good = open(path).read()
    with pytest.raises(TypeError):
        stats.write_json(path, {"x": object()})
    assert open(path).read() == good and os.listdir(tmp_path) == ["stats.json"]
    assert stats.fingerprint({"a": 1, "b": [1]}) == stats.fingerprint({"b": [1], "a": 1})
    assert stats.float_features({"features": {"x": {"dtype": "float32"}, "y": {"dtype": "int64"}, "z": {"dtype": "['float64']"}}}) == ["x", "z"]


def test_shards():
    assert sampling.shard_count(50, 8, 3) == 3 and sampling.shard_count(50, 100, 9) == 1
    assert sampling.balance([(5,), (1,), (3,), (2,)], 2) == [0, 1, 1, 1]
    loads = [0] * 4
    parts = [(n,) for n in np.random.default_rng(0).integers(1, 9, 60).tolist()]
    for p, s in zip(parts, sampling.balance(parts, 4)):
        loads[s] += p[0]
    assert max(loads) - min(loads) <= 8 and all(loads)


def test_every_step_is_in_one_shard(spark):
    df = spark.createDataFrame([("d", e, e, n) for e, n in ((0, 10), (1, 1), (2, 0), (3, 33))] + [("e", 0, 0, 2)], "dataset_id string, episode_index long, sequence long, length int")
    got = sampling.assign_shards(df, ["dataset_id", "episode_index"], "length", 0.25, 12, seed=1).collect()
    assert sum(r["n_steps"] for r in got if r["dataset_id"] == "d") == 44 and len({r["shard"] for r in got if r["dataset_id"] == "d"}) == 4
    steps = sampling.shuffled_steps(df, ["dataset_id", "episode_index"], "length", 4)
    assert steps.distinct().count() == 46
    assert sampling.assign_shards(df.where("false"), ["dataset_id", "episode_index"], "length", 1, 5).count() == 0


def test_schedule_uses_up_shards_before_repeating(spark):
    src = spark.createDataFrame([("a", 3, 1.0), ("b", 5, 3.0)], "k string, n int, w double")
    rows = sampling.schedule(src, "k", "w", "n", 200, seed=4).orderBy("position").collect()
    assert len(rows) == 200 and 30 < sum(r["k"] == "a" for r in rows) < 75
    a = [r["shard"] for r in rows if r["k"] == "a"]
    assert all(sorted(a[i : i + 3]) == [0, 1, 2] for i in range(0, len(a) - 3, 3))
    rank, worker = sampling.partition_of(__import__("pyspark").sql.functions.col("position"), 2, 3)
    parts = sampling.schedule(src, "k", "w", "n", 200, seed=4).select(rank.alias("r"), worker.alias("w")).groupBy("r", "w").count().collect()
    assert len(parts) == 6 and sum(p["count"] for p in parts) == 200


def test_accuracy_and_drift(spark):
    df = spark.createDataFrame([("k", i, p, l) for i, (p, l) in enumerate([(1, 9), (2, 1), (-100, -100), (4, 5)])], "k string, i int, p int, l int")
    r = evaluation.masked_accuracy(df, ["k"], "i", "p", "l").first()
    assert (r["correct"], r["total"]) == (1, 2)
    pins = spark.createDataFrame([("m1", "a", "1"), ("m2", "a", "1"), ("m1", "b", "1"), ("m2", "b", "2"), ("m1", "c", None)], "manifest string, package string, spec string")
    assert {(r["package"], r["kind"]) for r in maintenance.manifest_drift(pins).collect()} == {("b", "version"), ("c", "presence")}


def test_modalities():
    c = m.ModalityConfig((0, 4, 8), ("a", "b"), sincos=("a",), actions=(m.ActionConfig("relative"), m.ActionConfig("absolute", "pose", "rot6d", "eef")))
    assert c.horizon == 9 and c.mode("a") == "sincos" and c.mode("b") == "minmax" and c.action_of("b").reference("b") == "eef" and c.action_of("a").reference("a") == "a"
    for bad in (lambda: m.ModalityConfig((), ("a",)), lambda: m.ModalityConfig((0,), ("a",), sincos=("x",)), lambda: m.ActionConfig("absolute", "joint", "rot6d"), lambda: m.ActionConfig("odd"), lambda: m.ModalityConfig((0,), ("a", "b"), actions=(m.ActionConfig(),))):
        with pytest.raises(ValueError):
            bad()
    got = m.checked({"state": c, "language": m.ModalityConfig((0,), ("x", "y")), "odd": c})
    assert sorted(got) == ["language", "state"] and got["language"].keys == ("x",)
    with pytest.raises(ValueError):
        m.checked({"language": m.ModalityConfig((0, 1), ("x",))})
    m.streaming_deltas((-4, -2, 0))
    for bad in ((), (0, 1), (-3, -2, 0), (-1,)):
        with pytest.raises(ValueError):
            m.streaming_deltas(bad)
    assert m.matched_video_keys(["a"], ["x"]) == {"x": "a"} and m.matched_video_keys(["a"], ["a", "b"]) == {"a": "a"}
    with pytest.raises(KeyError):
        m.matched_video_keys(["a", "c"], ["x"])
    reg = m.Registry()
    reg.register("t", {"state": c})
    with pytest.raises(ValueError):
        reg.register("t", {"state": c})
    assert reg["t"]["state"] is c
    assert [s["ratio"] for s in m.mixture([{"tag": "a", "ratio": 3}, {"tag": "b"}])] == [0.75, 0.25]
    for bad in ([{"tag": "a", "ratio": 0}], [{"ratio": 1}], []):
        with pytest.raises(ValueError):
            m.mixture(bad)


def test_blocks_of_parts_have_shards_of_their_own(spark):
    df = spark.createDataFrame([("d", e, e, 9) for e in range(100)], "dataset_id string, episode_index long, sequence long, length int")
    got = sampling.assign_shards(df, ["dataset_id", "episode_index"], "length", 0.5, 60, seed=1, at_once=50).collect()
    load = {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["n_steps"]
    assert len(got) == 200 and sum(load.values()) == 900 and sorted(load) == list(range(len(load))) and len(load) > 12


def test_evaluation_order(spark):
    src = spark.createDataFrame([("b", 2), ("a", 3), ("c", 0)], "k string, n int")
    assert [tuple(r) for r in sampling.evaluation_schedule(src, "k", "n").orderBy("position").collect()] == [(0, "a", 0), (1, "a", 1), (2, "a", 2), (3, "b", 0), (4, "b", 1)]


def _order(spark, seed):
    df = spark.createDataFrame([("d", 0, 0, 200)], "dataset_id string, episode_index long, sequence long, length int")
    rows = sampling.shuffled_steps(df, ["dataset_id", "episode_index"], "length", 1000, seed).collect()
    return [r["step"] for r in sorted(rows, key=lambda r: r["split"])]


def test_seeds_give_other_orders_draws_and_dropouts(spark):
    orders = [_order(spark, s) for s in (0, 1, 2, 1000)]
    assert all(sorted(o) == list(range(200)) for o in orders)
    for i, a in enumerate(orders):
        for b in orders[:i]:
            assert abs(np.corrcoef(a, b)[0, 1]) < 0.25 and sum(x == y for x, y in zip(a, b)) < 10
    src = spark.createDataFrame([("a", 3, 1.0), ("b", 5, 2.0), ("c", 4, 5.0)], "k string, n int, w double")
    draws = [[r["k"] for r in sampling.schedule(src, "k", "w", "n", 4000, seed=s).orderBy("position").collect()] for s in (0, 1)]
    assert 0.3 < np.mean([x == y for x, y in zip(*draws)]) < 0.65  # as independent draws agree
    for d in draws:
        want = {"a": 500, "b": 1000, "c": 2500}
        assert sum((d.count(k) - n) ** 2 / n for k, n in want.items()) < 14  # chi-square, 2 degrees, p < 0.001
    v = F.array(F.lit(1.0))
    out = [[r[0][0] == 0 for r in spark.range(4000).select(sampling.excluded(v, F.col("id"), 0.3, s)).collect()] for s in (0, 7)]
    assert all(1080 < sum(o) < 1320 for o in out) and 0.5 < np.mean([x == y for x, y in zip(*out)]) < 0.66


def test_hash_spreads_evenly(spark):
    from trajspark.functions.text import portable_hash

    for seed in (0, 5):
        n = [r["count"] for r in spark.range(64_000).groupBy((portable_hash(F.col("id"), seed) % 64).alias("b")).count().collect()]
        assert len(n) == 64 and sum((x - 1000) ** 2 / 1000 for x in n) < 120


def test_white_space_of_any_script_stays(spark):
    from trajspark.functions.text import normalize_language

    text = "A b　c d\x1ce, f\x85g_h-i"
    assert spark.createDataFrame([(text,)], "t string").select(normalize_language(F.col("t"))).first()[0] == "a b　c d\x1ce f\x85g_hi"


def test_fingerprints_are_those_of_stored_caches():
    import hashlib
    import json

    spec = stats.feature_spec("action", {"dtype": "float32", "shape": [7], "names": None})
    text = json.dumps({"feature": "action", "dtype": "float32", "shape": [7]}, sort_keys=True, separators=(",", ":"))
    assert stats.fingerprint(spec) == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    act = m.ModalityConfig((0, 1), ("b", "a", "c"), actions=(m.ActionConfig("relative"), m.ActionConfig("relative", "pose", "rot6d", "eef"), m.ActionConfig("absolute")))
    specs = stats.relative_specs("tag", act, m.ModalityConfig((0,), ("a",)))
    assert list(specs) == ["a", "b"]
    assert specs["a"] == {"embodiment_tag": "tag", "action_key": "a", "action_delta_indices": [0, 1], "state_delta_indices": [0], "rep": "RELATIVE", "type": "EEF", "format": "XYZ_ROT6D", "state_key": "eef"}


def test_a_data_set_is_not_emptied(spark):
    eps = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "dataset_id string, episode_index long")
    bad = spark.createDataFrame([("a", 1, "x"), ("b", 0, "y"), ("b", 0, "z")], "dataset_id string, episode_index long, path string")
    assert {tuple(r) for r in maintenance.repaired(eps, bad).select("dataset_id", "episode_index", "refused").collect()} == {("a", 0, False), ("b", 0, True)}


def test_numbers_through_blocks(spark):
    from trajspark.plans.ranks import numbered

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = numbered(df, ["k"], F.expr("id div 64"), ["id"]).collect()
    assert all(r["rank"] == r["id"] // 3 for r in got) and len(got) == 1000
    assert numbered(df.where("false"), ["k"], F.expr("id div 64"), ["id"]).count() == 0


def test_bounds_per_step(spark):
    from trajspark.functions import normalize

    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [[0.0, 0.0], [0.0, 4.0]], [[2.0, 4.0], [6.0, 4.0]])], "c array<array<double>>, lo array<array<double>>, hi array<array<double>>")
    c, lo, hi = (F.col(x) for x in ("c", "lo", "hi"))
    r = df.select(normalize.steps(c, normalize.minmax, lo, hi, per_step=True).alias("a"), normalize.steps(c, normalize.minmax, lo[0], hi[0]).alias("b")).first()
    assert r["a"] == [[0.0, 0.0], [0.0, 0.0]] and r["b"] == [[0.0, 0.0], [2.0, 1.0]]


def _sampled(spark, tmp_path):
    """A small stored table of lengths whose steps are many, and its shards, with what Spark thinks of their sizes."""
    keys = ["dataset_id", "episode_index"]
    at = str(tmp_path / "lengths.parquet")
    spark.range(40).selectExpr("concat('d', id % 3) dataset_id", "id episode_index", "id sequence", "cast(20 + id as int) length").write.parquet(at)
    lengths = spark.read.parquet(at)
    sampling.assign_shards(lengths, keys, "length", 0.25, 60, seed=1).write.parquet(str(tmp_path / "shards.parquet"))
    return keys, lengths, spark.read.parquet(str(tmp_path / "shards.parquet"))


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_exploded_steps_are_not_broadcast(spark, tmp_path):
    keys, lengths, shards = _sampled(spark, tmp_path)
    steps = sampling.dealt_steps(shards, lengths, keys, "length", 4)
    need = sampling.needed_frames(steps, [*keys, "shard"], [-3, 0, 3], lengths)
    assert _broadcasts(steps) == _broadcasts(need) == 0
    n = {r["episode_index"]: r["length"] for r in lengths.collect()}
    want = {(r["dataset_id"], r["episode_index"], r["shard"], min(max(0, r["step"] + d), n[r["episode_index"]] - 1)) for r in steps.collect() for d in (-3, 0, 3)}
    got = [tuple(r) for r in need.select(*keys, "shard", "frame").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_only_the_schedule_is_broadcast_when_shards_are_materialized(spark, tmp_path):
    keys, lengths, shards = _sampled(spark, tmp_path)
    windows = str(tmp_path / "windows.parquet")
    lengths.selectExpr(*keys, "explode(sequence(0, length - 1)) frame_index", "sequence task_index").write.parquet(windows)
    plan = sampling.evaluation_schedule(shards.groupBy("dataset_id").agg(__import__("pyspark").sql.functions.count_distinct("shard").alias("n")), "dataset_id", "n")
    got = sampling.materialize(plan, sampling.dealt_steps(shards, lengths, keys, "length", 4), spark.read.parquet(windows), keys, "frame_index")
    assert _broadcasts(got) == 1
    rows = got.collect()
    assert len(rows) == sum(20 + i for i in range(40)) == len({(r["episode_index"], r["step"]) for r in rows})
    assert all(r["task_index"] == r["episode_index"] for r in rows)
    assert len({(r["position"], r["emitted"]) for r in rows}) == len(rows)
