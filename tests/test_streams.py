import numpy as np
from pyspark.sql import functions as F

from trajspark.operators import windows
from trajspark.streaming import scans

DDL = "k string, i long, x double, d boolean"


def _rows(n=60):
    r = np.random.default_rng(5)
    return [(k, i, float(r.random()), bool(r.random() < 0.1)) for k in "abc" for i in range(n)]


def _stream(spark, tmp_path, rows, per_file=20):
    """Rows as a stream of several micro-batches, in order within each key."""
    for b in range(0, 60, per_file):
        spark.createDataFrame([r for r in rows if b <= r[1] < b + per_file], DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _collect(spark, stream, tmp_path, name):
    out = str(tmp_path / f"out-{name}")
    q = scans.write_batches(stream, out, str(tmp_path / f"state-{name}"))
    q.awaitTermination()
    assert len(list((tmp_path / f"out-{name}").iterdir())) > 1  # several micro-batches
    return {tuple(map(str, r)) for r in spark.read.schema(stream.schema).parquet(f"{out}/*").collect()}


def test_streams_equal_batches(spark, tmp_path):
    rows = _rows()
    stream, static = _stream(spark, tmp_path, rows), spark.createDataFrame(rows, DDL)
    plan = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.array(F.col("x") + j))
    cases = {
        "history": (scans.history(["k", "i"], "x", 4, [-3, 0]), "k string, i long, history array<double>", ["k", "i", "history"]),
        "reward": (scans.episode_reward(["k", "i"], "x", "d", 5, "sum", most=12), "k string, i long, reward double, steps long, done boolean", ["k", "i", "reward", "steps", "done"]),
        "latch": (scans.latch(["k", "i"], "x", 7), "k string, i long, latched double", ["k", "i", "latched"]),
        "resample": (scans.resample(["k", "i"], "x", 0.0, 0.01), "k string, i long, slot long", ["k", "i", "slot"]),
        "ensemble": (scans.ensemble(["k", "i"], "p", 3), "k string, i long, vector array<double>", ["k", "i", "vector"]),
        "replan": (scans.replan(["k", "i"], "p", 3), "k string, i long, vector array<double>", ["k", "i", "vector"]),
    }
    for name, (step, ddl, names) in cases.items():
        s, b = (df.withColumn("p", plan) if name in ("ensemble", "replan") else df for df in (stream, static))
        want = {tuple(map(str, r)) for r in scans.batch_scan(b, ["k"], ["i"], step, ddl, names).collect()}
        assert _collect(spark, scans.stream_scan(s, ["k"], ["i"], step, ddl, names), tmp_path, name) == want and want, name


def test_scans_equal_the_window_operators(spark):
    static = spark.createDataFrame(_rows(), DDL)
    got = scans.batch_scan(static, ["k"], ["i"], scans.latch(["k", "i"], "x", 7), "k string, i long, latched double", ["k", "i", "latched"])
    assert got.exceptAll(windows.latched(static, ["k"], "i", "x", 7).select("k", "i", "latched")).count() == 0
    planned = static.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.array(F.col("x") + j)))
    a = scans.batch_scan(planned, ["k"], ["i"], scans.ensemble(["k", "i"], "p", 3), "k string, i long, vector array<double>", ["k", "i", "vector"])
    b = windows.ensemble(planned, ["k"], "i", "p", 4, most=3)
    close = a.join(b.select("k", F.col("step").cast("long").alias("i"), F.col("vector").alias("w")), ["k", "i"]).where(F.abs(F.col("vector")[0] - F.col("w")[0]) < 1e-9)
    assert close.count() == static.count()


def test_reward_state_does_not_grow():
    step, state, got = scans.episode_reward([], "x", "d", 3, "mean"), {}, []
    for i in range(1000):
        state, rows = step(state, {"x": float(i), "d": i == 998})
        got += rows
        assert len(str(state)) < 100
    assert got[0] == {"reward": 1.0, "steps": 3, "done": False} and got[-1]["done"] and got[-1]["steps"] == 999 and abs(got[-1]["reward"] - 499) < 1e-9
