"""Mixing sources to target weights: subset-sum budget fitting over counts of exact sizes.

Records of a source are counted by exact size. Whole passes over the source are taken while the
budget allows; of one more pass every size gives its proportional share, and a bounded-knapsack
dynamic program over bit sets closes the budget that is left. Which records of a size are taken is
decided by a seeded hash, in ranks that are counted per hash bucket first, so that no size held by
very many records has to be ordered in one task.
"""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Budget the dynamic program covers in one bit set, and items it considers at most; what lies
#: beyond is taken greedily, larger budgets before the program, further items after it.
DP_BITS, DP_ITEMS = 1 << 22, 512
#: Bits of the hash that name a bucket at least, and records a bucket should hold of the commonest size.
BITS, IN_BUCKET = 8, 100_000


def knapsack(sizes: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """Counts per size, at most as given, whose total is the greatest up to `budget` that is found.

    Exact while `budget` is within DP_BITS and the counts split into at most DP_ITEMS binary items.
    """
    left = {s: c for s, c in sizes if s > 0 and c > 0}
    taken: dict[int, int] = {}
    for s in sorted(left, reverse=True):  # greedy down to what the bit set covers
        if budget <= DP_BITS:
            break
        k = min(left[s], budget // s)
        if k:
            taken[s], budget = k, budget - k * s
            left[s] -= k
    items: list[tuple[int, int]] = []
    for s in sorted(left, reverse=True):
        c, k = min(left[s], budget // s), 1
        while c > 0 and len(items) < DP_ITEMS:
            items.append((s, min(k, c)))
            c, k = c - k, 2 * k
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for s, k in items:
        steps.append(reach)
        reach = (reach | reach << (s * k)) & mask
        if reach >> budget:
            break
    best = reach.bit_length() - 1
    for (s, k), before in zip(reversed(items[: len(steps)]), reversed(steps)):
        if not before >> best & 1:
            taken[s] = taken.get(s, 0) + k
            best -= s * k
            budget -= s * k
            left[s] -= k
    for s in sorted(left, reverse=True):  # sizes beyond the items, until no size fits
        k = min(left[s], budget // s)
        if k:
            taken[s], budget = taken.get(s, 0) + k, budget - k * s
    return taken


def fit_source(sizes: list[tuple[int, int]], budget: float, most: int) -> tuple[int, dict[int, int]]:
    """(whole passes, {size: records taken once more}) for one source.

    A budget the source can't reach with `most` passes takes all of them. A source without supply,
    a budget of 0 or no passes allowed give nothing.
    """
    supply = sum(s * c for s, c in sizes)
    if supply <= 0 or budget <= 0 or most <= 0:
        return 0, {}
    if most * supply <= budget:
        return most, {}
    passes = int(budget // supply)
    rest = int(budget) - passes * supply
    once = {s: int(c * (rest / supply)) for s, c in sizes}
    rest -= sum(s * k for s, k in once.items())
    for s, k in knapsack([(s, c - once[s]) for s, c in sizes], max(0, rest)).items():
        once[s] += k
    return passes, {s: k for s, k in once.items() if k}


def robot_sources(info: DataFrame) -> DataFrame:
    """(dataset_id, source, size): each data set's robot type and frames, as of the highest revision that tells them."""
    plain = F.lower(F.regexp_replace("robot_type", "[ -]", "_"))
    return (
        info.where("dataset_id is not null")
        .groupBy("dataset_id")
        .agg(F.max_by(plain, F.when(F.col("robot_type").isNotNull() & (F.col("robot_type") != ""), F.col("revision"))).alias("source"), F.max_by("total_frames", F.when(F.col("total_frames") != 0, F.col("revision"))).alias("size"))
        .where("source is not null and size > 0")
        .select("dataset_id", "source", F.col("size").cast("bigint").alias("size"))
    )


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    first = pdf.iloc[0]
    sizes = [(int(s), int(c)) for s, c in zip(pdf["size"], pdf["n"]) if s == s and s is not None and c > 0]
    passes, once = fit_source(sizes, float(first["budget"]), int(first["max_repeats"]))
    rows = [(int(first["mix_id"]), first["robot_type"], first["source"], float(first["target_share"]), int(first["max_repeats"]), s, passes, once.get(s, 0), c) for s, c in sizes]
    return pd.DataFrame(rows, columns=["mix_id", "robot_type", "source", "target_share", "max_repeats", "size", "passes", "once_more", "n"])


def fit_mixes(records: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan by size, targets with supply and budget) for records (.., source, size) and targets.

    targets: mix_id, robot_type, target_share, max_repeats; the total of a mix is the sum of its
    sources' supplies, and a source's budget is its share of that. The group of a source holds its
    distinct sizes, never its records.
    """
    counts = records.groupBy("source", "size").agg(F.count("*").alias("n"))
    supply = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("supply"))
    wanted = (
        targets.where("mix_id is not null and robot_type is not null and target_share is not null and max_repeats is not null")
        .select("mix_id", "robot_type", F.lower(F.regexp_replace("robot_type", "[ -]", "_")).alias("source"), "target_share", "max_repeats")
        .distinct()
        .join(supply, "source", "left")
        .fillna(0, ["supply"])
    )
    each = wanted.select("mix_id", "source", "supply").distinct().groupBy("mix_id").agg(F.sum("supply").alias("total"))
    wanted = wanted.join(each, "mix_id").withColumn("budget", F.col("target_share") * F.col("total"))
    plan = (
        wanted.join(counts, "source")
        .groupBy("mix_id", "robot_type", "source", "max_repeats", "target_share")
        .applyInPandas(_fit, "mix_id int, robot_type string, source string, target_share double, max_repeats int, size long, passes int, once_more long, n long")
    )
    return plan, wanted


def mix_report(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: supply, budget, what the fitted plan selects, its actual share, and whether the target is reached.

    A target is out of reach if the plan used every pass it may over all of the source and still
    selects less than the budget. A source without supply selects nothing.
    """
    plan, wanted = fit_mixes(records, targets)
    taken = F.col("passes") * F.col("n") + F.col("once_more")
    got = plan.groupBy("mix_id", "robot_type", "target_share", "max_repeats").agg(F.sum(F.col("size") * taken).alias("selected"), F.bool_and(taken >= F.col("max_repeats") * F.col("n")).alias("used_up"))
    out = wanted.join(got, ["mix_id", "robot_type", "target_share", "max_repeats"], "left").fillna(0, ["selected"]).fillna(True, ["used_up"])
    total = F.sum("selected").over(Window.partitionBy("mix_id"))
    return out.select(
        "mix_id", "robot_type", "target_share", "max_repeats", "supply", "budget", "selected",
        F.when(total > 0, F.col("selected") / total).alias("actual_share"),
        (~F.col("used_up") | (F.col("selected") >= F.col("budget"))).alias("reachable"),
    )


def mix_selection(records: DataFrame, targets: DataFrame, id_column: str, seed: int = 0) -> DataFrame:
    """The selected records of every mix: (mix_id, robot_type, id_column, size, repeats).

    Among the records of one size those of the smallest seeded hash (ties: smaller id) get one pass
    more. Records not selected are left out. Ranks are counted by bucket of the hash, more of them for more records.
    """
    plan, _ = fit_mixes(records, targets)
    rows = plan.join(records.select("source", "size", id_column), ["source", "size"]).withColumn("h", F.xxhash64(F.lit(seed), "mix_id", id_column))
    bits = max(BITS, (records.count() // IN_BUCKET).bit_length())
    rows = rows.withColumn("bucket", F.shiftright("h", 64 - bits))
    key = ["mix_id", "robot_type", "size"]
    per = rows.groupBy(*key, "bucket").agg(F.count("*").alias("in_bucket"))
    w = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("in_bucket").over(w), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("h", id_column)) + F.col("before")
    picked = rows.join(per, [*key, "bucket"]).withColumn("repeats", F.col("passes") + (rank <= F.col("once_more")).cast("int"))
    return picked.where("repeats > 0").select("mix_id", "robot_type", id_column, "size", "repeats")
