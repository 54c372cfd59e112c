"""Splits that keep related records together: components by large-star and small-star, then hashed ranges."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trajspark.plans.shared import cut, cut_at, discard
from trajspark.plans.sizes import small_side


def _stored(e: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The edges stored, where, and their number and sum of hashes, observed while they are written."""
    seen = Observation()
    e, at = cut_at(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
    return e, at, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of the undirected graph `edges` (a, b: bigint); a node without edges isn't listed.

    Alternates large-star (each node's greater neighbours are tied to its least one) and small-star
    (its lesser ones are) until nothing changes, which takes rounds by the logarithm of the longest
    chain. The least neighbour is found by partial aggregation and joined back, so a node with very
    many neighbours is split by adaptive execution. Each round is stored to cut its lineage, counted and
    hashed as it is written, and the one before is then deleted.
    """
    e, at, last = _stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        was, (e, at, now) = at, _stored(small.distinct())
        discard(was)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(records: DataFrame, keys: list[str], entities: list[str]) -> DataFrame:
    """(keys, component): records that share a value of any of `entities`, directly or through others.

    Values are compared without outer spaces and case; null, empty and 'unknown' link nothing.
    Several rows of one record link all their values. The nodes of the graph are the values, not the
    records: a record only ties its own values together, so a value shared by a third of all records
    is one node. A component is named by its least value; a record that links to nothing is one of
    its own, with a null component.
    """
    plain = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    values = F.array_compact(F.array(*[F.when((plain(c) != "") & (plain(c) != "unknown"), F.concat(F.lit(f"{c}:"), plain(c))) for c in entities]))
    rows = records.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys, values.alias("v"))
    rows = rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("v")))).alias("v"))
    rows = cut(rows)
    nodes = cut(rows.select(F.explode("v").alias("value")).distinct().withColumn("id", F.monotonically_increasing_id()))
    pairs = rows.where("size(v) > 1").select(F.col("v")[0].alias("x"), F.explode(F.expr("slice(v, 2, size(v) - 1)")).alias("y")).distinct()
    of = lambda c, i: nodes.select(F.col("value").alias(c), F.col("id").alias(i))
    found = components(pairs.join(of("x", "a"), "x").join(of("y", "b"), "y").select("a", "b"))
    named = nodes.join(found, nodes["id"] == found["node"], "left").select("value", F.coalesce("root", "id").alias("root"))
    names = named.groupBy("root").agg(F.min("value").alias("component"))
    named = named.join(names, "root").select("value", "component")
    return rows.withColumn("value", F.element_at(F.when(F.size("v") > 0, F.col("v")), 1)).join(named, "value", "left").select(*keys, "component")


def split_of(component: Column, shares: dict[str, float], seed: int = 0) -> Column:
    """The split whose range of [0, 1) the component's seeded hash (52 bits of MD5, which any engine has) falls into; shares must add up to 1."""
    if abs(sum(shares.values()) - 1) > 1e-9 or min(shares.values()) < 0:
        raise ValueError("the shares of the splits must add up to 1")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), component)), 1, 13)
    at = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))
    out, upto, names = None, 0.0, list(shares)
    for n in names[:-1]:
        upto += shares[n]
        out = F.when(at < upto, n) if out is None else out.when(at < upto, n)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def in_ranges(ranges: Column, index: Column) -> Column:
    """Whether `index` lies in one of comma-separated half-open ranges; an empty bound is open, a lone number is itself. Null if `ranges` is."""

    def inside(r: Column) -> Column:
        lo, hi = F.trim(F.split(r, ":")[0]), F.trim(F.try_element_at(F.split(r, ":"), F.lit(2)))
        above = (lo == "") | (index >= lo.try_cast("bigint"))
        below = (hi == "") | (index < hi.try_cast("bigint"))
        return F.when(r.contains(":"), above & below).otherwise(index == lo.try_cast("bigint"))

    return F.exists(F.split(ranges, ","), lambda r: F.coalesce(inside(r), F.lit(False)))


ENTITIES = ["operator_id", "session_id", "object_set_id"]
KEYS = ["dataset_id", "episode_index"]


def episode_splits(episodes: DataFrame, shares: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """(dataset_id, episode_index, component, split) of the episodes with a row not deleted."""
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    rows = grouped(episodes.where("deleted_at is null"), KEYS, ENTITIES)
    own = F.coalesce("component", F.concat_ws(":", F.lit("episode"), *KEYS))
    return rows.withColumn("component", own).withColumn("split", split_of(F.col("component"), shares, seed))


def split_report(splits: DataFrame) -> DataFrame:
    """(split, n_records, n_components, largest, share): what each split really got, and its largest component."""
    per = splits.groupBy("split", "component").agg(F.count("*").alias("n"))
    out = per.groupBy("split").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_components"), F.max("n").alias("largest"))
    return out.withColumn("share", F.col("n_records") / splits.agg(F.count("*")).scalar())


def broken_splits(episodes: DataFrame, info: DataFrame) -> DataFrame:
    """Episodes of linked groups that the declared training ranges cut apart: (dataset_id, episode_index).

    The range is that of the data set's highest revision; with a null range, or without a row in
    info, an episode is on neither side.
    """
    declared = info.groupBy("dataset_id").agg(F.max_by("splits.train", "revision").alias("train"))
    rows = cut(grouped(episodes.where("deleted_at is null"), KEYS, ENTITIES).where("component is not null"))
    sided = rows.join(small_side(declared), "dataset_id", "left").withColumn("inside", in_ranges(F.col("train"), F.col("episode_index")))
    mixed = sided.groupBy("component").agg(F.max("inside").alias("some_in"), F.min("inside").alias("all_in")).where("some_in and not all_in")
    return rows.join(small_side(mixed.select("component")), "component", "left_semi").select(*KEYS)
