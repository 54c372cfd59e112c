"""Repairing the metadata of stored data sets whose files are partly missing."""

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.paths import fill_path
from trajspark.operators.maintenance import repaired
from trajspark.plans.files import opened
from trajspark.plans.shared import cut
from trajspark.plans.sizes import small_side
from trajspark.sources import layouts


def repair_store(spark: SparkSession, root: str, dry_run: bool = False, caches: tuple[str, ...] = ("stats", "relative_stats")) -> DataFrame:
    """Drops the episodes of all data sets of the older layout under `root` whose data file is missing.

    Per data set (dataset, kept, dropped, refused): episode lines and the totals of info.json are
    rewritten, files of statistics are deleted, to be computed again. A data set that would lose all its
    episodes is refused: nothing of it is changed. With `dry_run` nothing is written; any dropped > 0 says
    that a run would change something.
    """
    lines = spark.read.text(f"{root}/*/meta/episodes.jsonl").select(F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/meta/", 1).alias("dataset_id"), F.col("value").alias("line"))
    eps = lines.select("*", F.from_json("line", "episode_index long, length long").alias("e")).where("e.episode_index is not null").select("dataset_id", "line", "e.*")
    info = layouts.scan_objects(spark, root, "info").select(F.col("dataset").alias("dataset_id"), "body", F.get_json_object("body", "$.data_path").alias("pattern"), F.get_json_object("body", "$.chunks_size").cast("int").alias("chunks_size"))
    older = F.lit("data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet")
    numbers = {"episode_chunk": F.expr("episode_index div chunks_size"), "episode_index": F.col("episode_index")}
    need = eps.join(small_side(info.drop("body")), "dataset_id").select("dataset_id", "episode_index", fill_path(F.coalesce("pattern", older), numbers, {}).alias("path"))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/*/data").select(F.regexp_extract("path", "/([^/]+)/data/", 1).alias("dataset_id"), F.regexp_extract("path", "/(data/.*)$", 1).alias("path"))
    kept = cut(repaired(eps, need.join(there, ["dataset_id", "path"], "left_anti")))
    n = eps.groupBy("dataset_id").agg(F.count("*").alias("_n"))
    report = cut(kept.groupBy("dataset_id").agg(F.count("*").alias("kept"), F.first("refused").alias("refused")).join(n, "dataset_id").select(F.col("dataset_id").alias("dataset"), "kept", (F.col("_n") - F.col("kept")).alias("dropped"), "refused"))
    if dry_run:
        return report
    changed = small_side(report.where("dropped > 0").select(F.col("dataset").alias("dataset_id")))
    rows = kept.join(changed, "dataset_id")
    totals = rows.join(small_side(info.select("dataset_id", "chunks_size")), "dataset_id").groupBy("dataset_id").agg(F.count("*").alias("total_episodes"), F.sum("length").alias("total_frames"), F.count_distinct(F.expr("episode_index div chunks_size")).alias("total_chunks"))

    def updated(body: str, episodes: int, frames: int, chunks: int) -> str:
        data = json.loads(body) | {"total_episodes": episodes, "total_frames": frames, "total_chunks": chunks}
        if isinstance(data.get("splits"), dict) and "train" in data["splits"]:
            data["splits"] = data["splits"] | {"train": f"0:{episodes}"}
        return json.dumps(data)

    bodies = cut(info.join(totals, "dataset_id").select("dataset_id", F.udf(updated)("body", "total_episodes", "total_frames", "total_chunks").alias("line")))
    meta = lambda name: F.concat("dataset_id", F.lit(f"/meta/{name}"))
    layouts.write_files(rows.select(meta("episodes.jsonl").alias("at"), "episode_index", "line"), root, F.col("at"), ["at", "episode_index"], lines=True)
    layouts.write_files(bodies.select(meta("info.json").alias("at"), "line"), root, F.col("at"), ["at"], lines=True)

    def forget(batches):
        fs, base = opened(root)
        for b in batches:
            for ds in b.column(0).to_pylist():
                for name in caches:
                    at = f"{base}/{ds}/meta/{name}.json"
                    if fs.get_file_info(at).is_file:
                        fs.delete_file(at)
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["dataset_id"])

    cut(changed.mapInArrow(forget, "dataset_id string"))
    return report
