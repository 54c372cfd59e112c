"""References to records that do not exist: compressed bitmaps, reference AND NOT parent.

Keys are integers already (episode and task numbers) or are encoded by the dictionary of the
references themselves (a video's code is episode number * cameras + camera). Per relation, data
set, key range and month of reference one container holds the referring keys; per relation, data
set and key range two containers hold the keys with any row and with a row not deleted, beside
the arrival time of each set bit. AND NOT leaves the missing and the deleted, the aligned arrival
times the late; surviving bits are decoded and joined back to their references.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.bitmaps import RANGE, KeyBits
from trajspark.functions.paths import fill_path, plain_path
from trajspark.plans.shared import cut
from trajspark.plans.sizes import small_side

GROUP = ["relation", "dataset_id", "key_range"]


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(relation, dataset_id, key_range, period, refs, parents) to the surviving bits."""
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("relation", "dataset_id", "code", "period", "state", "live_at")}
        for row in range(b.num_rows):
            refs, parents = b.column(4)[row].values, b.column(5)[row].values
            at = np.asarray(refs.field("pos"), dtype=np.int64)
            first = np.asarray(refs.field("at"), dtype=np.int64)
            if parents is not None and len(parents):
                pos = np.asarray(parents.field("pos"), dtype=np.int64)
                alive = parents.field("at").is_valid().to_numpy(zero_copy_only=False)
                arrived = parents.field("at").fill_null(0).to_numpy(zero_copy_only=False)
            else:
                pos, alive, arrived = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
            bits, some, live = KeyBits.of(at), KeyBits.of(pos), KeyBits.of(pos[alive])
            # times aligned with the set bits: one entry a key on either side, by position
            i, j = np.argsort(at), np.argsort(pos[alive])
            met = bits.both(live).decode()
            lives = arrived[alive][j][np.searchsorted(pos[alive][j], met)]
            slow = lives > first[i][np.searchsorted(at[i], met)]
            late, times = met[slow], lives[slow]
            base = b.column(2)[row].as_py() * RANGE
            for state, keys in (("missing", bits.and_not(some).decode()), ("deleted", bits.both(some).and_not(live).decode()), ("late", late)):
                n = len(keys)
                out["relation"] += [b.column(0)[row].as_py()] * n
                out["dataset_id"] += [b.column(1)[row].as_py()] * n
                out["period"] += [b.column(3)[row].as_py()] * n
                out["code"] += (keys.astype(np.int64) + base).tolist()
                out["state"] += [state] * n
                out["live_at"] += times.tolist() if state == "late" else [None] * n
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("relation", pa.string()), ("dataset_id", pa.string()), ("code", pa.int64()), ("period", pa.string()), ("state", pa.string()), ("live_at", pa.int64())]))


def dangling(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references of `refs` whose target is missing, deleted or late.

    refs: relation, dataset_id, code, ref_at (microseconds) and any further columns, one row a reference.
    parents: relation, dataset_id, code, live_at (null if all rows are deleted), one row a key.
    Adds period (yyyy-MM of ref_at) and state. References with a null code or time are left out; an
    empty parent side makes every reference missing. Several references to one key are one bit.
    `refs` is read twice, so give a stored table.
    """
    refs = refs.where("code is not null and ref_at is not null").withColumn("period", F.date_format(F.timestamp_micros("ref_at"), "yyyy-MM"))
    span = F.expr(f"code div {RANGE}")
    asked = (
        refs.groupBy("relation", "dataset_id", "code", "period")
        .agg(F.min("ref_at").alias("at"))
        .groupBy("relation", "dataset_id", span.alias("key_range"), "period")
        .agg(F.collect_list(F.struct((F.col("code") % RANGE).cast("int").alias("pos"), "at")).alias("refs"))
    )
    held = parents.groupBy("relation", "dataset_id", span.alias("key_range")).agg(F.collect_list(F.struct((F.col("code") % RANGE).cast("int").alias("pos"), F.col("live_at").alias("at"))).alias("parents"))
    bits = asked.join(held, GROUP, "left").select(*GROUP, "period", "refs", "parents")
    left = bits.mapInArrow(_survivors, "relation string, dataset_id string, code long, period string, state string, live_at long")
    return refs.join(left, ["relation", "dataset_id", "code", "period"]).where("state <> 'late' or ref_at < live_at").drop("live_at")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def project_references(frames: DataFrame, episodes: DataFrame, tasks: DataFrame, info: DataFrame, modality: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, parents) of frames to episodes, frames to tasks and episodes to videos.

    frames is read once; everything is pre-aggregated by key before it is shuffled.
    """
    told = frames.where("dataset_id is not null and episode_index is not null").groupBy("dataset_id", "episode_index", "task_index").agg(F.min(_micros("received_at")).alias("ref_at"))
    told = cut(told)
    to_episode = (
        told.groupBy("dataset_id", "episode_index")
        .agg(F.min("ref_at").alias("ref_at"))
        .select(F.lit("frames.episode_index").alias("relation"), "dataset_id", "episode_index", F.col("episode_index").alias("code"), F.col("episode_index").cast("string").alias("target_key"), "ref_at")
    )
    to_task = told.where("task_index is not null").select(
        F.lit("frames.task_index").alias("relation"), "dataset_id", "episode_index", F.col("task_index").alias("code"), F.col("task_index").cast("string").alias("target_key"), "ref_at"
    )
    live = F.when(F.col("deleted_at").isNull(), _micros("received_at"))
    known = episodes.where("dataset_id is not null and episode_index is not null").groupBy("dataset_id", F.col("episode_index").alias("code")).agg(F.min(live).alias("live_at"))
    cameras = (
        modality.where("modality = 'video' and original_key is not null")
        .select("dataset_id", "original_key")
        .distinct()
        .withColumn("camera", F.row_number().over(Window.partitionBy("dataset_id").orderBy("original_key")) - 1)
        .withColumn("cameras", F.count("*").over(Window.partitionBy("dataset_id")))
    )
    current = info.where("video_path is not null and chunks_size > 0").groupBy("dataset_id").agg(F.max_by(F.struct("video_path", "chunks_size"), "revision").alias("i")).select("dataset_id", "i.*")
    ep, size = F.col("episode_index"), F.col("chunks_size")
    chunk = F.expr("episode_index div chunks_size")
    path = fill_path(
        F.col("video_path"),
        {"episode_chunk": chunk, "chunk_index": chunk, "episode_index": ep, "file_index": F.expr("(episode_index % chunks_size) div 3")},
        {"video_key": F.col("original_key")},
    )
    sources = current.join(cameras, "dataset_id")
    to_video = cut(
        known.where("live_at is not null")
        .withColumnRenamed("code", "episode_index")
        .join(small_side(sources), "dataset_id")
        .withColumn("target_key", path)
        .where("target_key is not null")
        .select(F.lit("episodes.video_path").alias("relation"), "dataset_id", "episode_index", (ep * F.col("cameras") + F.col("camera")).alias("code"), "target_key", F.col("live_at").alias("ref_at"))
    )
    coded = (
        files.where("kind = 'video' and path is not null")
        .groupBy("dataset_id", plain_path(F.col("path")).alias("path"))
        .agg(F.min(live).alias("live_at"))
        .join(to_video.select("dataset_id", "code", plain_path(F.col("target_key")).alias("path")), ["dataset_id", "path"])
        .select(F.lit("episodes.video_path").alias("relation"), "dataset_id", "code", "live_at")
    )
    parents = (
        known.select(F.lit("frames.episode_index").alias("relation"), "dataset_id", "code", "live_at")
        .unionByName(tasks.where("dataset_id is not null and task_index is not null").groupBy("dataset_id", F.col("task_index").alias("code")).agg(F.min(live).alias("live_at")).select(F.lit("frames.task_index").alias("relation"), "dataset_id", "code", "live_at"))
        .unionByName(coded)
    )
    return to_episode.unionByName(to_task).unionByName(to_video), parents


def orphan_references(frames: DataFrame, episodes: DataFrame, tasks: DataFrame, info: DataFrame, modality: DataFrame, files: DataFrame) -> DataFrame:
    """Dangling references as (src_table, ref_field, dataset_id, episode_index, target_key, state, period)."""
    refs, parents = project_references(frames, episodes, tasks, info, modality, files)
    name = F.split("relation", r"\.", 2)
    return dangling(refs, parents).select(name[0].alias("src_table"), name[1].alias("ref_field"), "dataset_id", "episode_index", "target_key", "state", "period")


def orphan_report(found: DataFrame) -> DataFrame:
    """Dangling references counted per table, field, state and period."""
    return found.groupBy("src_table", "ref_field", "state", "period").agg(F.count("*").alias("n"))
