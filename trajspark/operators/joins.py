"""Joins of frames with their dimensions, and interval joins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.text import portable_hash
from trajspark.plans.records import EPISODE
from trajspark.plans.sizes import small_side

#: Frames of one bucket of the interval join.
SPAN = 256


def task_text(frames: DataFrame, tasks: DataFrame, strict: bool = False) -> DataFrame:
    """Adds `task`: the text of the frame's task, as last received and not deleted; null if there is none.

    With `strict` an unknown index is an error.
    """
    known = tasks.where("deleted_at is null").groupBy("dataset_id", "task_index").agg(F.max_by("task", F.struct("received_at", "task")).alias("task"))
    out = frames.join(small_side(known), ["dataset_id", "task_index"], "left")
    if strict:
        bad = F.col("task").isNull() & F.col("task_index").isNotNull()
        out = out.withColumn("task", F.when(bad, F.raise_error(F.concat(F.lit("unknown task "), F.col("task_index").cast("string")))).otherwise(F.col("task")))
    return out


def within_length(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """Frames below their episode's nominal length; frames of unknown episodes are left out."""
    return frames.join(episodes.select(*EPISODE, "length"), EPISODE).where("frame_index < length")


def interval_text(frames: DataFrame, episodes: DataFrame, lead: int, seed: int = 0) -> DataFrame:
    """Adds `text`: a sub-task whose [start - lead, end) holds the frame; '' if none does.

    Of several, a seeded hash picks one. Intervals are cut into buckets of SPAN frames, so that the
    join is an equality on (episode, bucket) however many intervals and frames an episode has.
    """
    spans = episodes.select(*EPISODE, F.explode("sub_tasks").alias("s")).select(*EPISODE, F.greatest(F.col("s.start") - lead, F.lit(0)).alias("lo"), F.col("s.end").alias("hi"), F.col("s.text").alias("text")).where("hi > lo")
    spans = spans.select("*", F.explode(F.sequence(F.expr(f"lo div {SPAN}"), F.expr(f"(hi - 1) div {SPAN}"))).alias("bucket"))
    left = frames.withColumn("bucket", F.expr(f"frame_index div {SPAN}"))
    met = left.join(spans, [*EPISODE, "bucket"], "left")
    ok = F.col("lo").isNotNull() & (F.col("frame_index") >= F.col("lo")) & (F.col("frame_index") < F.col("hi"))
    rank = F.struct(portable_hash(F.col("frame_index") * 7919 + F.col("lo"), seed), "lo", "hi", "text")
    keep = [c for c in frames.columns if c not in (*EPISODE, "frame_index")]
    return met.groupBy(*EPISODE, "frame_index").agg(*[F.first(c).alias(c) for c in keep], F.coalesce(F.min(F.when(ok, rank))["text"], F.lit("")).alias("text"))


def slice_statistics(stats: DataFrame, modality: DataFrame) -> DataFrame:
    """Statistics of the named slices: each row of `stats` under its group's name and local dimension."""
    groups = modality.where("modality in ('state', 'action') and start is not null").select("dataset_id", F.col("key").alias("group"), "start", F.col("end").alias("stop"), F.coalesce("original_key", F.when(F.col("modality") == "state", F.lit("observation.state")).otherwise(F.lit("action"))).alias("key"))
    return (
        stats.where("modality = 'stats'").drop("modality", "step").join(small_side(groups), ["dataset_id", "key"]).where("dim >= start and dim < stop").withColumn("dim", F.col("dim") - F.col("start")).drop("start", "stop")
    )


def mismatched(left: DataFrame, right: DataFrame, keys: list[str], on: Column) -> DataFrame:
    """Rows of a full join on `keys` for which `on` does not hold, a missing side included."""
    return left.join(right, keys, "full").where(~F.coalesce(on, F.lit(False)))


def action_references(modality: DataFrame, state_keys: dict[str, str] | None = None) -> DataFrame:
    """(dataset_id, action, state, start, stop): the state slice each action group is relative to, by `state_keys` or else its own key.

    start and stop are null where the data set has no such state group.
    """
    named = {k: v for k, v in (state_keys or {}).items()}
    key = F.coalesce(F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.col("key")], F.col("key")) if named else F.col("key")
    actions = modality.where("modality = 'action'").select("dataset_id", F.col("key").alias("action"), key.alias("state")).distinct()
    states = modality.where("modality = 'state'").select("dataset_id", F.col("key").alias("state"), "start", F.col("end").alias("stop")).distinct()
    return actions.join(small_side(states), ["dataset_id", "state"], "left")


def adapted_input(rows: DataFrame, state: str, modality: DataFrame) -> DataFrame:
    """Adds `input`: the named state slices of each row, in order of their names, as one vector; the map of them as `named`."""
    slices = modality.where("modality = 'state' and start is not null").groupBy("dataset_id").agg(F.array_sort(F.collect_set(F.struct("key", "start", F.col("end").alias("stop")))).alias("_s"))
    part = lambda s: F.slice(F.col(state), s["start"] + 1, F.greatest(s["stop"] - s["start"], F.lit(0)))
    out = rows.join(small_side(slices), "dataset_id").withColumn("named", F.map_from_entries(F.transform("_s", lambda s: F.struct(s["key"], part(s)))))
    return out.withColumn("input", F.flatten(F.transform("_s", lambda s: F.col("named")[s["key"]]))).drop("_s")
