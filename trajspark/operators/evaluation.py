"""Evaluation: prediction errors, rollout results, latencies, accuracies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trajectory_errors(pairs: DataFrame, keys: list[str], truth: Column, prediction: Column) -> DataFrame:
    """Mean squared and absolute error per trajectory over all steps and dimensions: (keys, mse, mae)."""
    d = F.aggregate(F.zip_with(truth.cast("array<double>"), prediction.cast("array<double>"), lambda a, b: F.struct(((a - b) * (a - b)).alias("s"), F.abs(a - b).alias("a"))), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("a")), lambda t, x: F.struct((t["s"] + x["s"]).alias("s"), (t["a"] + x["a"]).alias("a")))
    rows = pairs.select(*keys, d.alias("d"), F.size(truth).alias("n"))
    return rows.groupBy(*keys).agg((F.sum("d.s") / F.sum("n")).alias("mse"), (F.sum("d.a") / F.sum("n")).alias("mae"))


def mean_of_means(errors: DataFrame) -> DataFrame:
    """The plain mean over trajectories, whatever their lengths."""
    return errors.agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.count("*").alias("n"))


def rollouts(steps: DataFrame, keys: list[str], order: str, reward: str, success: str) -> DataFrame:
    """Per episode: length, summed reward, whether any step succeeded, the last and greatest reward, and validity."""
    return steps.groupBy(*keys).agg(
        F.count("*").alias("length"),
        F.sum(reward).alias("reward"),
        F.bool_or(success).alias("success"),
        F.max_by(reward, order).alias("progress"),
        F.max(reward).alias("best"),
        F.bool_and(F.col(reward).isNotNull()).alias("valid"),
    )


def success_rate(results: DataFrame, keys: list[str]) -> DataFrame:
    """Success over the valid episodes: (keys, n, rate)."""
    return results.where("valid").groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("success").cast("int")).alias("rate"))


def signals(steps: DataFrame, keys: list[str], flags: list[str], distances: list[str]) -> DataFrame:
    """Signals of an episode: a flag if any step had it, the least of each distance (1e9 without one)."""
    return steps.groupBy(*keys).agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags], *[F.coalesce(F.min(d), F.lit(1e9)).alias(d) for d in distances])


def outcome(success: Column, target: Column, other: Column) -> Column:
    """Which of six cases an episode is, by success and by which of two objects was grasped."""
    return F.when(success & target & ~other, 1).when(success, 2).when(target & ~other, 3).when(target, 4).when(~other, 5).otherwise(6)


def follows(case: Column) -> Column:
    return case <= 3


def collapse(method: str, x: Column) -> Column:
    """max, min, mean or sum."""
    return {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}[method](x)


def latencies(df: DataFrame, key: str, ms: str, baseline: str) -> DataFrame:
    """Median per configuration, its frequency in Hz, and the speedup over the baseline's median."""
    med = df.groupBy(key).agg(F.median(ms).alias("median_ms"))
    base = df.where(F.col(key) == baseline).agg(F.median(ms)).scalar()
    return med.select(key, "median_ms", (1000 / F.col("median_ms")).alias("hz"), (base / F.col("median_ms")).alias("speedup"))


def masked_accuracy(df: DataFrame, keys: list[str], order: str, prediction: str, label: str, ignore: int = -100) -> DataFrame:
    """Predictions against the next row's labels, ignoring masked ones: (keys, correct, total, accuracy)."""
    nxt = F.lead(label).over(Window.partitionBy(*keys).orderBy(order))
    rows = df.withColumn("_next", nxt).where(F.col("_next").isNotNull())
    counted = F.col("_next") != ignore
    correct, total = F.count_if(counted & (F.col(prediction) == F.col("_next"))), F.count_if(counted)
    return rows.groupBy(*keys).agg(correct.alias("correct"), total.alias("total"), (correct / F.greatest(total, F.lit(1))).alias("accuracy"))


def best_so_far(df: DataFrame, order: str, metric: str, keys: list[str] | None = None) -> DataFrame:
    """Rows whose metric is strictly better than all before."""
    w = Window.partitionBy(*(keys or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_best", F.max(metric).over(w)).where(F.col("_best").isNull() | (F.col(metric) > F.col("_best"))).drop("_best")


def running_accuracy(counts: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """(keys, batch, correct, total, accuracy): counters carried over the batches of a key, in order; 0 over nothing."""
    w = Window.partitionBy(*keys).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    c, n = F.sum("correct").over(w), F.sum("total").over(w)
    return counts.select(*keys, batch, c.alias("correct"), n.alias("total"), (c / F.greatest(n, F.lit(1))).alias("accuracy"))


def across_ranks(metrics: DataFrame, rank: str, value: str, least: float) -> DataFrame:
    """(rank, own, mean, go_on): each rank's mean, the mean of these, and whether the first rank's reaches `least`, as all ranks are told."""
    own = metrics.groupBy(rank).agg(F.avg(value).alias("own"))
    all_ = own.agg(F.struct(F.avg("own").alias("mean"), (F.min_by("own", rank) >= least).alias("go_on"))).scalar()
    return own.withColumn("_all", all_).select(rank, "own", "_all.mean", "_all.go_on")
