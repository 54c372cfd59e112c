"""Repairing, converting and validating stored data sets."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.paths import fill_path, plain_path
from trajspark.plans.sizes import small_side


def required_files(episodes: DataFrame, info: DataFrame, modality: DataFrame) -> DataFrame:
    """(dataset_id, episode_index, path): the files each episode needs by its data set's patterns."""
    current = info.where("chunks_size > 0").groupBy("dataset_id").agg(F.max_by(F.struct("data_path", "video_path", "chunks_size"), "revision").alias("i")).select("dataset_id", "i.*")
    cameras = modality.where("modality = 'video' and original_key is not null").groupBy("dataset_id").agg(F.sort_array(F.collect_set("original_key")).alias("cameras"))
    rows = episodes.select("dataset_id", "episode_index").distinct().join(small_side(current.join(cameras, "dataset_id", "left")), "dataset_id")
    chunk = F.expr("episode_index div chunks_size")
    numbers = {"episode_chunk": chunk, "chunk_index": chunk, "episode_index": F.col("episode_index"), "file_index": F.expr("(episode_index % chunks_size) div 3")}
    videos = F.transform(F.coalesce("cameras", F.array().cast("array<string>")), lambda c: fill_path(F.col("video_path"), numbers, {"video_key": c}))
    paths = F.array_compact(F.concat(F.array(fill_path(F.col("data_path"), numbers, {})), videos))
    return rows.select("dataset_id", "episode_index", F.explode(paths).alias("path"))


def missing_files(required: DataFrame, files: DataFrame) -> DataFrame:
    """Required files that aren't stored (deleted ones count as absent)."""
    there = files.where("deleted_at is null and path is not null").select("dataset_id", plain_path(F.col("path")).alias("path")).distinct()
    return required.withColumn("path", plain_path(F.col("path"))).join(there, ["dataset_id", "path"], "left_anti")


def repaired(episodes: DataFrame, missing: DataFrame) -> DataFrame:
    """Episodes without a missing file, with `refused`.

    A data set that would lose all its episodes isn't touched: it keeps them all, marked `refused`.
    """
    bad = missing.select("dataset_id", "episode_index").distinct().withColumn("_bad", F.lit(True))
    rows = episodes.join(bad, ["dataset_id", "episode_index"], "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    lost = rows.groupBy("dataset_id").agg(F.min("_bad").alias("refused"))
    return rows.join(small_side(lost), "dataset_id").where("refused or not _bad").drop("_bad")


def examples(missing: DataFrame, episodes: int = 20, paths: int = 4) -> DataFrame:
    """A report of at most so many episodes and paths each."""
    ranked = missing.withColumn("r", F.row_number().over(Window.partitionBy("dataset_id", "episode_index").orderBy("path"))).where(F.col("r") <= paths)
    each = ranked.groupBy("dataset_id", "episode_index").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return each.orderBy("dataset_id", "episode_index").limit(episodes)


def summary(episodes: DataFrame, chunks_size: int | Column, cameras: Column) -> DataFrame:
    """Updated totals per data set: episodes, frames, videos, chunks and the range of all episodes."""
    size = F.lit(chunks_size) if isinstance(chunks_size, int) else chunks_size
    return episodes.groupBy("dataset_id").agg(
        F.count("*").alias("total_episodes"),
        F.sum("length").alias("total_frames"),
        (F.count("*") * F.first(cameras)).alias("total_videos"),
        F.count_distinct(F.floor(F.col("episode_index") / size)).alias("total_chunks"),
        F.concat(F.lit("0:"), F.count("*").cast("string")).alias("train_split"),
    )


def discontinuities(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Where slices (keys, key, start, end), in order of their starts, leave a gap or overlap."""
    was = F.coalesce(F.lag("end").over(Window.partitionBy(*keys).orderBy("start", "end")), F.lit(0))
    return slices.withColumn("expected", was).where("start <> expected").withColumn("kind", F.when(F.col("start") > F.col("expected"), "gap").otherwise("overlap")).select(*keys, "key", "expected", "start", "kind")


def manifest_drift(pins: DataFrame) -> DataFrame:
    """Packages present in some manifests but not all, or with differing specifications.

    pins: manifest, package, spec. Result: (package, kind, n_manifests, n_specs).
    """
    total = pins.agg(F.count_distinct("manifest")).scalar()
    per = pins.groupBy("package", "manifest").agg(F.array_join(F.sort_array(F.collect_set(F.coalesce("spec", F.lit("")))), "|").alias("signature"))
    per = per.groupBy("package").agg(F.count_distinct("manifest").alias("n_manifests"), F.count_distinct("signature").alias("n_specs"))
    kind = F.when(F.col("n_manifests") < F.col("all_manifests"), "presence").when(F.col("n_specs") > 1, "version")
    return per.withColumn("all_manifests", total).withColumn("kind", kind).where("kind is not null").select("package", "kind", "n_manifests", "n_specs")


def segments(episodes: DataFrame, keys: list[str], order: str, frames: str, fps: Column) -> DataFrame:
    """Where each episode lies in a file that holds several in order: (.., start_s, end_s, duration_s)."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = F.sum(frames).over(w.rowsBetween(Window.unboundedPreceding, 0))
    begin = upto - F.col(frames)
    return episodes.select(*keys, order, (begin / fps).alias("start_s"), (upto / fps).alias("end_s"), (F.col(frames) / fps).alias("duration_s"))


def episode_files(frames: DataFrame, chunks_size: int) -> DataFrame:
    """The file per episode of the older layout: (dataset_id, episode_index, chunk, path, n_rows, first, last)."""
    chunk = F.expr(f"episode_index div {chunks_size}")
    path = F.format_string("data/chunk-%03d/episode_%06d.parquet", chunk, F.col("episode_index"))
    return frames.groupBy("dataset_id", "episode_index").agg(F.count("*").alias("n_rows"), F.min("frame_index").alias("first"), F.max("frame_index").alias("last")).withColumn("chunk", chunk).withColumn("path", path)


def renumbered(df: DataFrame, keys: list[str], episode: str, order: str) -> DataFrame:
    """Episodes numbered 0, 1, .. without gaps per key, and rows numbered through the key.

    Only the episodes of a key, with their counts, are ordered in one task; its rows are per episode.
    """
    per = df.groupBy(*keys, episode).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(episode)
    per = per.withColumn("new_episode", F.row_number().over(w) - 1).withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, episode).orderBy(order)) - 1
    return df.withColumn("_within", within).join(per, [*keys, episode]).withColumn("new_index", F.col("_within") + F.col("_before")).drop("_within", "_before")


def template_faults(template: dict, state_dim: int, action_dim: int) -> list[str]:
    """What is wrong with a modality template: missing sections, state slices beyond the vector, action
    slices that don't cover theirs without gaps."""
    out = [f"section {s} is missing" for s in ("state", "action", "video", "annotation") if s not in template]
    ends = [g["end"] for g in template.get("state", {}).values()]
    if ends and max(ends) > state_dim:
        out.append(f"state slices reach {max(ends)} of {state_dim}")
    at = 0
    for start, end in sorted((g["start"], g["end"]) for g in template.get("action", {}).values()):
        if start != at:
            out.append(f"action slices break at {at}")
        at = end
    if at != action_dim and "action" in template:
        out.append(f"action slices cover {at} of {action_dim}")
    return out


def deploy(spark, root: str, template: dict) -> tuple[list[str], dict[str, list[str]]]:
    """Writes a template to every data set under `root` whose vectors it fits: (written, faults by data set)."""
    import json

    from trajspark.operators.stats import read_json, write_json
    from trajspark.sources.datasets import discover

    done, bad = [], {}
    for row in discover(spark, root).orderBy("dataset").toLocalIterator():
        at = row["dataset"].removeprefix("file:")
        feats = read_json(f"{at}/meta/info.json").get("features", {})
        dims = [int((feats.get(k, {}).get("shape") or [0])[0]) for k in ("observation.state", "action")]
        if found := template_faults(template, *dims):
            bad[at] = found
        else:
            write_json(f"{at}/meta/modality.json", json.loads(json.dumps(template)))
            done.append(at)
    return done, bad
