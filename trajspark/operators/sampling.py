"""Seeded shards, mixture schedules and disjoint partitions; hashes stand in for generators."""

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.text import portable_hash
from trajspark.plans.ranks import numbered
from trajspark.plans.sizes import by_shuffle, small_side


def shuffled_steps(lengths: DataFrame, keys: list[str], length: str, splits: int, seed: int = 0) -> DataFrame:
    """Every step of every sequence in one of its `splits` parts: (keys, step, split).

    The steps of a sequence are ordered by a seeded hash (ties: by step) and dealt out in turn; no
    step is left out, and a part nothing falls into does not appear. The hash also mixes `sequence`,
    a number of the sequence that `lengths` must hold.
    """
    steps = lengths.where(F.col(length) > 0).select(*keys, "sequence", F.explode(F.sequence(F.lit(0), F.col(length).cast("int") - 1)).alias("step"))
    h = portable_hash(F.col("step") * 7919 + F.col("sequence") * 104729, seed)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(h, "step")) - 1
    return steps.withColumn("split", rank % splits).drop("sequence")


def shard_count(total: int, size: int, parts: int) -> int:
    return min(-(-total // size), parts)


def balance(parts: list[tuple], shards: int) -> list[int]:
    """Shard of each part (.., size), in the order given: one each first, then always the least filled
    (ties: the lower number). As many steps as there are parts, on a heap."""
    out, heap = [], []
    for i, p in enumerate(parts):
        if i < shards:
            out.append(i)
            heapq.heappush(heap, (p[-1], i))
        else:
            load, s = heapq.heappop(heap)
            out.append(s)
            heapq.heappush(heap, (load + p[-1], s))
    return out


#: Parts balanced in one task; a source with more is cut into blocks of its seeded order, each
#: balanced over its own shards.
PARTS_AT_ONCE = 1_000_000


def assign_shards(lengths: DataFrame, keys: list[str], length: str, rate: float, shard_size: int, seed: int = 0, at_once: int = PARTS_AT_ONCE) -> DataFrame:
    """(source, keys, split, n_steps, shard): parts of the sequences dealt to balanced shards per source.

    `lengths`: keys (the source first), sequence (a number), length. A rate of 1/k cuts each sequence
    into k parts; parts go in seeded order. Balancing is sequential by definition: it runs per source
    over one small row a part, at most about `at_once` of them in a task.
    """
    import pandas as pd

    splits, source = max(1, int(1 / rate)), keys[0]
    n = F.col(length).cast("bigint")
    parts = lengths.where(n > 0).withColumn("split", F.explode(F.sequence(F.lit(0), F.least(F.lit(splits), n).cast("int") - 1)))
    parts = parts.withColumn("n_steps", F.floor((n - F.col("split") + splits - 1) / splits)).withColumn("_h", portable_hash(F.col("sequence"), seed))
    sizes = parts.groupBy(source).agg(F.ceil(F.count("*") / at_once).alias("_blocks"))
    parts = by_shuffle(parts).join(small_side(sizes), source).withColumn("_block", F.floor(F.col("_h") * F.col("_blocks") / (1 << 32)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "sequence", "split"])
        shards = shard_count(int(pdf["n_steps"].sum()), shard_size, len(pdf))
        return pdf.assign(shard=balance([(x,) for x in pdf["n_steps"].tolist()], shards))[[*keys, "split", "n_steps", "_block", "shard"]]

    kinds = dict(lengths.dtypes)
    ddl = ", ".join(f"{k} {kinds[k]}" for k in keys)
    dealt = parts.select(*keys, "sequence", "split", "n_steps", "_h", "_block").groupBy(source, "_block").applyInPandas(run, f"{ddl}, split int, n_steps long, _block long, shard int")
    first = dealt.groupBy(source, "_block").agg((F.max("shard") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(source).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("_before", before).drop("_n")
    return by_shuffle(dealt).join(first, [source, "_block"]).withColumn("shard", (F.col("shard") + F.col("_before")).cast("int")).select(*keys, "split", "n_steps", "shard")


def mixture_weights(sources: DataFrame, group: str, size: str, ratio: str) -> DataFrame:
    """Adds `weight`: the source's share of its group's size times the group's ratio."""
    return sources.withColumn("weight", F.col(size) / F.sum(size).over(Window.partitionBy(group)) * F.col(ratio))


#: Even parts of [0, 1) that draws and ranges of weights are joined by.
BINS = 4096


def schedule(sources: DataFrame, key: str, weight: str, shards: str, draws: int, seed: int = 0) -> DataFrame:
    """(position, key, shard): `draws` weighted draws of a source with replacement, its shards in turn.

    Each source's shards come in a seeded order that changes every time they are used up. The k-th
    draw of a source is shard k mod n of cycle k div n. `sources` has one row a source, with its number
    of shards: cumulative weights are ranges of [0, 1), cut at BINS even places, so that a draw meets
    the ranges of its bin by an equality join. Sources without weight or shards are never drawn.
    """
    some = sources.where((F.col(weight) > 0) & (F.col(shards) > 0))
    total = F.sum(weight).over(Window.partitionBy())
    w = Window.orderBy(key)
    upto = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total
    table = some.select(key, F.col(shards).alias("_n"), upto.alias("_upto")).withColumn("_from", F.coalesce(F.lag("_upto").over(w), F.lit(0.0)))
    edge = lambda c: F.least(F.floor(F.col(c) * BINS), F.lit(BINS - 1)).cast("int")
    ranges = table.withColumn("_bin", F.explode(F.sequence(edge("_from"), edge("_upto"))))
    u = portable_hash(F.col("position") + 1, seed) / F.lit(float(1 << 32))
    drawn = sources.sparkSession.range(draws).select(F.col("id").alias("position"), u.alias("_u")).withColumn("_bin", F.floor(F.col("_u") * BINS).cast("int"))
    drawn = drawn.join(small_side(ranges), "_bin").where("_u >= _from and _u < _upto").select("position", key, "_n")
    drawn = numbered(drawn, [key], F.expr("position div 65536"), ["position"], "_k")
    drawn = drawn.withColumn("_cycle", F.expr("_k div _n")).withColumn("_slot", F.col("_k") % F.col("_n"))
    order = table.withColumnRenamed("_n", shards).select(key, F.explode(F.sequence(F.lit(0), F.col(shards).cast("int") - 1)).alias("shard"))
    cycles = drawn.select(key, "_cycle").distinct().join(order, key)
    h = portable_hash(F.col("shard") * 7919 + F.col("_cycle") * 104729 + 1, seed)
    cycles = cycles.withColumn("_slot", F.row_number().over(Window.partitionBy(key, "_cycle").orderBy(h, "shard")) - 1)
    return drawn.join(cycles, [key, "_cycle", "_slot"]).select("position", key, "shard")


def evaluation_schedule(sources: DataFrame, key: str, shards: str) -> DataFrame:
    """Every shard of every source once, in order: (position, key, shard).

    Only the sources (one row each) are put in order; their shards are numbered from running totals.
    """
    n = F.col(shards).cast("bigint")
    before = F.coalesce(F.sum(n).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = sources.where(n > 0).select(key, before.alias("_before"), n.cast("int").alias("_n"))
    return counted.select(key, "_before", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("shard")).select((F.col("_before") + F.col("shard")).alias("position"), key, "shard")


def partition_of(position: Column, ranks: int, workers: int) -> tuple[Column, Column]:
    """(rank, worker) that takes a position: disjoint, and together everything."""
    at = position % (ranks * workers)
    return F.floor(at / workers).cast("int"), (at % workers).cast("int")


def dealt_steps(shards: DataFrame, lengths: DataFrame, keys: list[str], length: str, splits: int, seed: int = 0) -> DataFrame:
    """(keys, step, shard): every step with the shard its part was dealt to; `shards` as from assign_shards."""
    return shuffled_steps(lengths, keys, length, splits, seed).join(by_shuffle(shards.select(*keys, "split", "shard")), [*keys, "split"]).drop("split")


def materialize(plan: DataFrame, steps: DataFrame, windows: DataFrame, keys: list[str], step: str, seed: int = 0) -> DataFrame:
    """The scheduled shards with their data: (plan's columns, keys, step, emitted, windows' columns).

    Each step of a shard meets the window of its `step`; steps without one are left out. `emitted` is
    its place within the shard at that position, shuffled by a seeded hash of position and step. The
    window is over one shard, which is bounded by the size shards are made for.
    """
    rows = small_side(plan).join(by_shuffle(steps), [keys[0], "shard"]).join(by_shuffle(windows.withColumnRenamed(step, "step")), [*keys, "step"])
    h = portable_hash(F.col("position") * 15485863 + F.col(keys[-1]) * 104729 + F.col("step"), seed)
    return rows.withColumn("emitted", F.row_number().over(Window.partitionBy("position").orderBy(h, *keys, "step")) - 1)


def needed_frames(steps: DataFrame, keys: list[str], deltas: list[int], lengths: DataFrame | None = None, length: str = "length") -> DataFrame:
    """(keys, frame): the distinct frames that windows at `deltas` around the steps read.

    With `lengths` (length, and those of the keys that name a sequence) positions are clamped to the
    sequence, as padding does; without, those below 0 are left out. Steps are brought together by keys
    first and multiplied by the deltas there.
    """
    frame = lambda d: F.col("step") + d
    if lengths is not None:
        on = [k for k in keys if k in lengths.columns]
        steps = steps.join(by_shuffle(lengths.select(*on, F.col(length).alias("_n"))), on)
        frame = lambda d: F.greatest(F.lit(0), F.least(F.col("step") + d, F.col("_n") - 1))
    at = steps.repartition(*keys).select(*keys, F.explode(F.array(*[frame(d) for d in deltas])).alias("frame"))
    return at.where("frame >= 0").distinct()


def excluded(v: Column, key: Column, probability: float, seed: int = 0) -> Column:
    """The vector zeroed with a probability, by a seeded hash of `key`."""
    u = portable_hash(key, seed) / F.lit(float(1 << 32))
    return F.when(u < probability, F.transform(v, lambda _: F.lit(0.0).cast("double"))).otherwise(v.cast("array<double>"))
