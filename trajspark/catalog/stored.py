"""Queries over stored data sets: the tables are written out in both layouts and read back."""

import io
import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.catalog.sequences import RECORDS
from trajspark.functions import images
from trajspark.functions import text as texts
from trajspark.operators import inference, stats
from trajspark.operators.maintenance import renumbered
from trajspark.plans import checks, files
from trajspark.plans.pieces import groups, partitions_of
from trajspark.plans.records import EPISODE, FRAME, frame_records, live_episodes
from trajspark.plans.shared import cut, shared_folder
from trajspark.plans.tables import table
from trajspark.sources import layouts, ndarrays, video
from trajspark.sources.datasets import converted_info, discover, file_index

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


FEATURES = {
    "observation.state": {"dtype": "float32", "shape": [8], "fps": 10},
    "action": {"dtype": "float32", "shape": [8], "fps": 10},
    "next.reward": {"dtype": "float32", "shape": [1]},
    "next.done": {"dtype": "bool", "shape": [1]},
    "task_index": {"dtype": "int64", "shape": [1]},
    "images.front": {"dtype": "video", "shape": [1, 1, 3], "fps": 10},
}
COLUMNS = ("index", "timestamp", "task_index", "observation.state", "action", "next.reward", "next.done")

#: Stores written by this process: (session, folder, layout) to its root.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """The frame records under the names they are stored by, without null task indexes."""
    rows = frame_records(table(spark, folder, "frames"), *COLUMNS)
    return rows.select(*FRAME, F.col("ts").alias("timestamp"), "task_index", F.col("state").alias("observation.state"), "action", F.col("reward").alias("next.reward"), F.col("done").alias("next.done"))


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    return frame_records(table(spark, folder, "frames")).groupBy(*EPISODE).agg(F.count("*").alias("n"))


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "tasks").where("deleted_at is null and dataset_id is not null and task_index is not null")
    return t.groupBy("dataset_id", "task_index").agg(F.max_by("task", F.struct("received_at", "task")).alias("task"))


def _info(version: str, n: int, frames: int) -> dict:
    return {"codebase_version": version, "fps": 10, "chunks_size": 50, "total_episodes": n, "total_frames": frames, "features": FEATURES, "data_files_size_in_mb": 100}


def _objects(rows: DataFrame, root: str, name: str, body) -> None:
    """A JSON object per data set, made by `body(row)` where the row is."""
    of = F.udf(lambda *x: json.dumps(body(*x)), "string")
    columns = [c for c in rows.columns if c != "dataset_id"]
    lines = rows.select("dataset_id", of(*columns).alias("line"))
    layouts.write_files(lines, root, F.concat("dataset_id", F.lit(f"/meta/{name}.json")), ["dataset_id"], lines=True)


def _store(spark: SparkSession, folder: str, layout: str) -> str:
    """The root of the data sets written in a layout, once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, layout)
    if key in _WRITTEN:
        return _WRITTEN[key]
    root = f"{shared_folder(spark).rstrip('/')}/store-{layout}-{uuid.uuid4().hex}"
    rows, n = _rows(spark, folder), _lengths(spark, folder)
    totals = n.groupBy("dataset_id").agg(F.count("*").alias("episodes"), F.sum("n").alias("frames"))
    lines = lambda df, name, order: layouts.write_files(df.select("dataset_id", F.col(order).alias("_order"), F.to_json(F.struct(*[F.col(c) for c in df.columns if c != "dataset_id"])).alias("line")).select(F.concat("dataset_id", F.lit(f"/meta/{name}.jsonl")).alias("at"), "_order", "line"), root, F.col("at"), ["at", "_order"], lines=True)
    if layout == "v2":
        path = F.format_string("%s/data/chunk-%03d/episode_%06d.parquet", "dataset_id", F.expr("episode_index div 50"), F.col("episode_index"))
        layouts.write_files(rows, root, path, ["episode_index", "frame_index"])
        lines(n.select(*EPISODE, F.col("n").alias("length")), "episodes", "episode_index")
        lines(_tasks(spark, folder), "tasks", "task_index")
        _objects(totals, root, "info", lambda e, f: _info("v2.1", e, f))
    else:
        file = F.expr("episode_index div 16")
        path = F.format_string("%s/data/chunk-000/file-%03d.parquet", "dataset_id", file)
        layouts.write_files(rows, root, path, ["episode_index", "frame_index"])
        numbers = renumbered(rows.select(*FRAME), ["dataset_id"], "episode_index", "frame_index").groupBy(*EPISODE).agg(F.min("new_index").alias("dataset_from_index"), (F.max("new_index") + 1).alias("dataset_to_index"))
        # every fifth episode's range ends one row early, so that its slice can't be trusted
        short = F.when(F.col("episode_index") % 5 == 0, 1).otherwise(0)
        meta = numbers.join(n, EPISODE).select(*EPISODE, F.when(F.col("episode_index") % 2 == 0, F.col("n")).alias("length"), "dataset_from_index", (F.col("dataset_to_index") - short).alias("dataset_to_index"), F.col("n").alias("stats/action/count"))
        layouts.write_files(meta, root, F.concat("dataset_id", F.lit("/meta/episodes/chunk-000/file-000.parquet")), ["episode_index"])
        t = _tasks(spark, folder).select("dataset_id", "task_index", F.col("task").alias("__index_level_0__"))
        layouts.write_files(t, root, F.concat("dataset_id", F.lit("/meta/tasks.parquet")), ["task_index"])
        _objects(totals, root, "info", lambda e, f: _info("v3.0", e, f))
    _WRITTEN[key] = root
    return root


_LEN = f"with {RECORDS}, n as (select dataset_id, episode_index, count(*) n, round(sum(r), 3) reward, sum(frame_index)::bigint frames, count(s) states from f group by all)"
_TASKS = "t as (select dataset_id, task_index, arg_max(task, (received_at, task)) task from tasks where deleted_at is null and task_index is not null and dataset_id is not null group by all)"


@query(_LEN + " select dataset_id, episode_index, n, reward, frames, states, printf('data/chunk-%03d/episode_%06d.parquet', episode_index // 50, episode_index) path from n")
def scan_older_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one episode each, scanned with the columns needed; the path tells the chunk (1, 26, 39, 110)."""
    df = layouts.scan_files(spark, _store(spark, folder, "v2")).withColumn("path", F.regexp_extract(F.col("_metadata.file_path"), "/(data/.*)$", 1))
    return df.groupBy(F.col("dataset").alias("dataset_id"), "episode_index", "path").agg(F.count("*").alias("n"), F.round(F.sum(F.col("`next.reward`").cast("double")), 3).alias("reward"), F.sum("frame_index").alias("frames"), F.count("`observation.state`").alias("states"))


@query(_LEN + f", {_TASKS}, k as (select dataset_id, count(*) tasks, count(task) texts from t group by 1) select n.dataset_id, count(*) episodes, sum(n)::bigint frames, any_value(coalesce(tasks, 0)) tasks, any_value(coalesce(texts, 0)) texts, 'v2.1' as version, 50 chunks_size, count(*) total_episodes, sum(n)::bigint total_frames from n left join k using (dataset_id) group by 1")
def scan_older_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Episode and task lines and the info objects of all data sets found (6, 7, 8, 10)."""
    root = _store(spark, folder, "v2")
    found = discover(spark, root).select(F.regexp_extract("dataset", "([^/]+)$", 1).alias("dataset"))
    e = layouts.scan_lines(spark, root, "episodes", "episode_index long, length long").groupBy("dataset").agg(F.count("*").alias("episodes"), F.sum("length").alias("frames"))
    t = layouts.scan_lines(spark, root, "tasks", "task_index long, task string").groupBy("dataset").agg(F.count("*").alias("tasks"), F.count("task").alias("texts"))
    i = layouts.scan_objects(spark, root, "info").select("dataset", F.from_json("body", "codebase_version string, chunks_size int, total_episodes long, total_frames long").alias("i")).select("dataset", F.col("i.codebase_version").alias("version"), "i.chunks_size", "i.total_episodes", "i.total_frames")
    return found.join(e, "dataset").join(t, "dataset", "left").fillna(0, ["tasks", "texts"]).join(i, "dataset").withColumnRenamed("dataset", "dataset_id")


@query(_LEN + " select dataset_id, episode_index, n - (episode_index % 5 = 0)::int n_slice, n n_rows, false fallback from n")
def scan_newer_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Row ranges of shared files beside the rows that say they are the episode's (2, 3)."""
    root = _store(spark, folder, "v3")
    rows = layouts.scan_files(spark, root).select("dataset", "episode_index", F.regexp_extract(F.col("_metadata.file_path"), "/(data/.*)$", 1).alias("path"), F.col("_metadata.row_index").alias("row"))
    e = layouts.scan_files(spark, root, "meta/episodes").select("dataset", "episode_index", F.col("dataset_from_index").alias("from"), F.col("dataset_to_index").alias("to"))
    e = e.withColumn("path", F.format_string("data/chunk-000/file-%03d.parquet", F.expr("episode_index div 16")))
    return layouts.episode_slices(rows, e).withColumnRenamed("dataset", "dataset_id")


@query(_LEN + " select dataset_id, episode_index, case when episode_index % 2 = 0 then n else n - (episode_index % 5 = 0)::int end length, n n_action, row_number() over (partition by dataset_id order by episode_index) as place from n")
def scan_newer_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Episode metadata in order, missing lengths derived, embedded statistics split off and nested (4, 29, 111)."""
    from pyspark.sql import Window

    from trajspark.sources.datasets import _nested_columns

    df = layouts.scan_files(spark, _store(spark, folder, "v3"), "meta/episodes")
    length = F.coalesce("length", F.col("dataset_to_index") - F.col("dataset_from_index"))
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("episode_index"))
    return df.select(F.col("dataset").alias("dataset_id"), "episode_index", length.alias("length"), _nested_columns(df.columns), place.alias("place")).select("dataset_id", "episode_index", "length", F.col("stats.action.count").alias("n_action"), "place")


@query(f"with {_TASKS} select dataset_id, task_index, task from t")
def scan_newer_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Task tables whose text is a named index (5, 111)."""
    t = spark.read.parquet(f"{_store(spark, folder, 'v3')}/*/meta/tasks.parquet")
    return t.select(F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/meta/", 1).alias("dataset_id"), "task_index", F.col("__index_level_0__").alias("task"))


@query(_LEN + " select dataset_id, printf('data/chunk-%03d/episode_%06d.parquet', episode_index // 50, episode_index) path from n")
def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Relative paths of all stored files, found by pattern and listing, contents not read (9, 11)."""
    root = _store(spark, folder, "v2")
    local = files.matching(f"{root.removeprefix('file://')}/*/meta/info.json")
    assert len(local) == discover(spark, root).count()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/*/data")
    return found.select(F.regexp_extract("path", "/([^/]+)/data/", 1).alias("dataset_id"), F.regexp_extract("path", "/(data/.*)$", 1).alias("path"))


@query(f"with {RECORDS}, v as (select dataset_id, episode_index, frame_index, s from f where s is not null and len(list_filter(s, lambda z: z is null or not isfinite(z))) = 0) select dataset_id, episode_index, count(*) n, sum(list_sum(list_transform(s, lambda z: (z > 0)::int)))::bigint lit from v group by all")
def scan_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Masks written as one .npz stack per episode and read frame by frame (12, 17)."""
    root = f"{shared_folder(spark).rstrip('/')}/masks-{uuid.uuid4().hex}"
    rows = frame_records(table(spark, folder, "frames"), "observation.state").where("state is not null and forall(state, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")

    def write(batches):
        for t in groups(batches, 2):
            ds, e = t.column(0)[0].as_py(), t.column(1)[0].as_py()
            states = t.column(3).combine_chunks()
            states = states.chunk(0) if isinstance(states, pa.ChunkedArray) else states
            width = len(states[0])
            if pc.any(pc.not_equal(pc.list_value_length(states), width)).as_py():
                raise ValueError(f"{ds}, episode {e}: states of several widths")
            b = io.BytesIO()
            np.savez(b, (states.flatten().to_numpy(zero_copy_only=False) > 0).astype(np.uint8).reshape(len(states), 1, width))
            files.write(f"{root}/{ds}/episode_{e:06d}.npz", b.getvalue())
            yield pa.RecordBatch.from_pydict({"dataset_id": [ds], "episode_index": [e]})

    sorted_rows = rows.select(*FRAME, "state").repartition(partitions_of(table(spark, folder, "frames")), *EPISODE).sortWithinPartitions(*FRAME)
    cut(sorted_rows.mapInArrow(write, "dataset_id string, episode_index long"))
    got = ndarrays.read_arrays(spark, root.removeprefix("file://"))
    # masks hold bytes 0 and 1: the ones are the 1s of their hexadecimal text
    lit = lambda d: F.length(F.translate(F.hex(d), "0", ""))
    keys = [F.regexp_extract("path", "/([^/]+)/episode_", 1).alias("dataset_id"), F.regexp_extract("path", r"episode_(\d+)", 1).cast("bigint").alias("episode_index")]
    return got.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(lit("data")).alias("lit"))


@query(f"with {RECORDS}, a as (select dataset_id, episode_index, arg_min(a, frame_index) a from f where a is not null and len(list_filter(a, lambda z: z is null or not isfinite(z))) = 0 group by all), d as (select dataset_id, row_number() over (order by dataset_id) - 1 dataset from (select distinct dataset_id from a)) select d.dataset, 'episode_' || episode_index trajectory, len(a.a) width, round(list_sum(a.a::double[]), 3) total from a join d using (dataset_id)")
def initial_actions(spark: SparkSession, folder: str) -> DataFrame:
    """First actions saved in a file per data set, and loaded over the whole mixture (21, 22, 34)."""
    root = f"{shared_folder(spark).rstrip('/')}/initial-{uuid.uuid4().hex}"
    rows = frame_records(table(spark, folder, "frames"), "action").where("action is not null and forall(action, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    first = rows.groupBy(*EPISODE).agg(F.min_by("action", "frame_index").alias("a"))

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        ds = pdf["dataset_id"].iloc[0]
        ndarrays.save_initial_actions([{f"episode_{e}": {"action": np.asarray(a, np.float32)} for e, a in zip(pdf["episode_index"], pdf["a"])}], f"{root}/{ds}.npz")
        return pd.DataFrame({"path": [f"{root}/{ds}.npz"]})

    saved = cut(first.groupBy("dataset_id").applyInPandas(save, "path string"))
    got = ndarrays.load_initial_actions(spark, sorted(r["path"] for r in saved.collect()))
    return got.select("dataset", "trajectory", F.size("vec").alias("width"), F.round(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x), 3).alias("total"))


@query(_LEN + " select dataset_id, episode_index, n + 2 as n, list_sum(list_transform(range(n), lambda k: k % 250 + 1))::bigint lit, 2 black, n pts_n, round(n * (n - 1) / 20.0, 4)::double pts from n")
def video_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Stacks per episode: all frames with their times, and frames by number with missing ones black (13, 16, 17)."""
    root = f"{shared_folder(spark).rstrip('/')}/videos-{uuid.uuid4().hex}"
    n = _lengths(spark, folder)

    def write(batches):
        for b in batches:
            paths = []
            for ds, e, k in zip(*(c.to_pylist() for c in b.columns)):
                import io

                out = io.BytesIO()
                np.save(out, (np.arange(k) % 250 + 1).astype(np.uint8)[:, None, None, None])
                files.write(path := f"{root}/{ds}/episode_{e:06d}.npy", out.getvalue())
                paths.append(path)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(paths, pa.string())], names=["dataset_id", "episode_index", "n", "path"])

    stored = cut(n.mapInArrow(write, "dataset_id string, episode_index long, n long, path string"))
    need = stored.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") + 1)).alias("frame"))
    value = F.conv(F.hex("data"), 16, 10).cast("bigint")
    got = video.decode(need, missing="black").groupBy("path").agg(F.count("*").alias("got"), F.sum(value).alias("lit"), F.count_if(value == 0).alias("black"))
    every = video.all_frames(stored.select("path"), fps=10.0).groupBy("path").agg(F.count("*").alias("pts_n"), F.round(F.sum("pts"), 4).alias("pts"))
    return stored.join(got, "path").join(every, "path").select(*EPISODE, F.col("got").alias("n"), "lit", "black", "pts_n", "pts")


@query("with i as (select distinct dataset_id, revision, fps, total_frames from info where fps > 0) select dataset_id, revision, round((fps * 1000)::double / 1001, 6) rate, case when revision % 2 = 0 then total_frames end declared, case when revision % 2 = 0 and total_frames is not null then total_frames else floor(2.5::double * ((fps * 1000)::double / 1001))::bigint end frames from i")
def video_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Frame rates from fractions; the number of frames as declared, else from the duration (18)."""
    i = table(spark, folder, "info").where("fps > 0").select("dataset_id", "revision", "fps", "total_frames").distinct()
    rate = texts.fraction(F.concat((F.col("fps") * 1000).cast("string"), F.lit("/1001")))
    declared = F.when(F.col("revision") % 2 == 0, F.col("total_frames"))
    return i.select("dataset_id", "revision", F.round(rate, 6).alias("rate"), declared.alias("declared"), video.frame_count(declared, rate, F.lit(2.5)).alias("frames"))


@query(_LEN + ", c as (select dataset_id, ceil(count(*) / 20.0)::int chunks from n group by 1) select dataset_id, episode_index, printf('data/chunk-%03d/episode_%06d.parquet', episode_index // 20, episode_index) path, n, 'v2.1' as version, chunks, false hinted, false paced from n join c using (dataset_id)")
def convert_layout(spark: SparkSession, folder: str) -> DataFrame:
    """The newer layout written as the older: a file per episode, lines of metadata, the rewritten info (26, 28, 31, 202)."""
    root, to = _store(spark, folder, "v3"), f"{shared_folder(spark).rstrip('/')}/converted-{uuid.uuid4().hex}"
    rows = layouts.scan_files(spark, root)
    path = F.format_string("%s/data/chunk-%03d/episode_%06d.parquet", "dataset", F.expr("episode_index div 20"), F.col("episode_index"))
    layouts.write_files(rows, to, path, ["episode_index", "frame_index"])
    _objects(layouts.scan_objects(spark, root, "info").select(F.col("dataset").alias("dataset_id"), "body"), to, "info", lambda body: converted_info(json.loads(body), 20))
    got = layouts.scan_files(spark, to).withColumn("path", F.regexp_extract(F.col("_metadata.file_path"), "/(data/.*)$", 1)).groupBy("dataset", "episode_index", "path").agg(F.count("*").alias("n"))
    info = layouts.scan_objects(spark, to, "info").select("dataset", F.get_json_object("body", "$.codebase_version").alias("version"), F.get_json_object("body", "$.total_chunks").cast("int").alias("chunks"), F.get_json_object("body", "$.data_files_size_in_mb").isNotNull().alias("hinted"), F.get_json_object("body", "$.features.action.fps").isNotNull().alias("paced"))
    return got.join(info, "dataset").withColumnRenamed("dataset", "dataset_id")


@query(f"with {RECORDS}, d as (select distinct dataset_id from f), s as (select * from (values ('first', 'action'), ('first', 'next.reward'), ('first', 'observation.state'), ('changed', 'action'), ('emptied', 'action'), ('emptied', 'next.reward'), ('emptied', 'observation.state')) t(run, feature)) select dataset_id, run, feature from d, s")
def stats_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Float features computed by a refreshed cache: all at first, none again, the one whose shape changed, all of a broken file (25, 58, 89, 91, 92)."""
    root = _store(spark, folder, "v2")
    caches = f"{shared_folder(spark).rstrip('/')}/caches-{uuid.uuid4().hex}"

    def run(batches):
        for b in batches:
            out = []
            for ds, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                info = json.loads(body)
                cache = stats.StatsCache(f"{caches}/{ds}/stats.json")
                specs = {k: stats.feature_spec(k, info["features"][k]) for k in stats.float_features(info)}
                compute = lambda names: {k: dict.fromkeys(stats.SIX, [0.0]) for k in names}
                out += [(ds, "first", k) for k in cache.refresh(specs, compute)]
                out += [(ds, "again", k) for k in cache.refresh(specs, compute)]
                specs["action"] = stats.feature_spec("action", info["features"]["action"] | {"shape": [9]})
                out += [(ds, "changed", k) for k in cache.refresh(specs, compute)]
                files.write(cache.path, b'{"action": {"mea')
                out += [(ds, "emptied", k) for k in cache.refresh(specs, compute)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3, names=["dataset_id", "run", "feature"])

    return layouts.scan_objects(spark, root, "info").mapInArrow(run, "dataset_id string, run string, feature string")


@query(f"with {RECORDS} select dataset_id, count(*) filter (a is null) missing, count(*) filter (a is not null and len(a) <> 7) narrow, count(*) n from f where a is null or len(a) <> 7 group by 1")
def observation_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose action is missing or not seven wide (63, 64)."""
    bad = checks.violations(frame_records(table(spark, folder, "frames"), "action"), {"action": checks.Spec("vector", width=7)})
    has = lambda t: F.count_if(F.array_contains("faults", t))
    null = F.count_if(F.col("action").isNull())
    return bad.groupBy("dataset_id").agg(null.alias("missing"), (has("action is not 7 wide") - null).alias("narrow"), F.count("*").alias("n"))


@query(f"with {RECORDS}, v as (select * from f where s is not null and len(list_filter(s, lambda z: z is null or not isfinite(z) or abs(z) >= 1e6)) = 0), c as (select dataset_id, k, list_transform(s, lambda z: z::float * (k + 1)) y from v, (select unnest(range(4)) k)) select dataset_id, k::int step, count(*) n, round(sum(list_sum(list_transform(y, lambda z: z::double))), 0) total from c group by all")
def batched_inference(spark: SparkSession, folder: str) -> DataFrame:
    """A policy loaded once a worker, batches of observations in, chunks of four vectors out (187, 188, 190)."""
    rows = frame_records(table(spark, folder, "frames"), "observation.state").where("state is not null and forall(state, x -> x is not null and not isnan(x) and abs(x) < 1e6)")

    def load():
        return lambda pdf: [np.outer(np.arange(1, 5), np.asarray(s, np.float32)).astype(np.float32) for s in pdf["state"]]

    out = inference.infer(rows, FRAME, load)
    steps = out.select("dataset_id", F.posexplode("chunk").alias("step", "v"))
    return steps.groupBy("dataset_id", "step").agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double"))), 0).alias("total"))


@query("""with x as (select vec_id, list_transform(embedding, lambda z: floor(greatest(0, least(1, z::double)) * 255)::int) p from embeddings),
y as (select vec_id, unnest(range(64)) i, p from x), z as (select vec_id, i // 8 r, i % 8 c, p[i + 1] v, p from y)
select vec_id, sum(v * (r * 8 + c + 1))::bigint whole, sum(v * ((7 - r) * 8 + c + 1))::bigint flipped, sum(case when r between 2 and 5 and c between 2 and 5 then v * ((r - 2) * 4 + c - 1) else 0 end)::bigint cropped,
 sum(case when r < 4 then v * ((r + 2) * 8 + c + 1) else 0 end)::bigint padded from z group by 1""")
def image_kernels(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as 8 x 8 pictures: to bytes, turned upside down, the centre half, the upper half in a square (132, 153, 154, 197)."""
    e = table(spark, folder, "embeddings")

    def run(batches):
        place = lambda x: int((x[..., 0].astype(np.int64) * (np.arange(x[..., 0].size) + 1).reshape(x.shape[:2])).sum())
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = images.to_uint8(np.asarray(v, np.float64).reshape(8, 8, 1))
                out.append((place(x), place(images.flip_vertical(x)), place(images.crop(x, 0.5)), place(images.letterbox(x[:4]))))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in zip(*out)]] if out else [b.column(0), *[pa.array([], pa.int64())] * 4], names=["vec_id", "whole", "flipped", "cropped", "padded"])

    return e.select("vec_id", "embedding").mapInArrow(run, f"vec_id {dict(e.dtypes)['vec_id']}, whole long, flipped long, cropped long, padded long")


@query("""with p as (select p_partkey, replace(p_name, ' ', '_') || '[extra] >= ' || p_size || ',<90 ; python_version > "3.' || (p_size % 9) || '"' as line from part)
select p_partkey, regexp_replace(lower(regexp_extract(trim(line), '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1)), '[-_.]+', '-', 'g') as name, '>=' || regexp_extract(line, '>= ([0-9]+),', 1) || ',<90' as spec, 'python_version > "3.' || regexp_extract(line, '"3\\.([0-9])"', 1) || '"' as marker from p""")
def requirement_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Dependency lines split into canonical name, version specification and marker (206)."""
    p = table(spark, folder, "part")
    line = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("[extra] >= "), F.col("p_size").cast("string"), F.lit(',<90 ; python_version > "3.'), (F.col("p_size") % 9).cast("string"), F.lit('"'))
    r = texts.requirement(line)
    return p.select("p_partkey", r["name"].alias("name"), r["spec"].alias("spec"), r["marker"].alias("marker"))


@query(_LEN + ", b as (select *, episode_index % 7 = 3 bad from n), r as (select *, bool_and(bad) over (partition by dataset_id) refused from b) select dataset_id, count(*) filter (refused or not bad) kept, count(*) filter (bad and not refused) dropped, any_value(refused) refused, count(*) filter (refused or not bad) total_episodes, sum(case when refused or not bad then n else 0 end)::bigint total_frames, count(distinct case when refused or not bad then episode_index // 50 end) chunks from r group by 1")
def repair_run(spark: SparkSession, folder: str) -> DataFrame:
    """Data sets that lost every seventh episode's file: lines and totals rewritten (60, 61, 203)."""
    from trajspark.sources.repair import repair_store

    root = f"{shared_folder(spark).rstrip('/')}/repair-{uuid.uuid4().hex}"
    rows, n = _rows(spark, folder), _lengths(spark, folder)
    path = F.format_string("%s/data/chunk-%03d/episode_%06d.parquet", "dataset_id", F.expr("episode_index div 50"), F.col("episode_index"))
    layouts.write_files(rows.where("episode_index % 7 <> 3"), root, path, ["episode_index", "frame_index"])
    lines = n.select(F.concat("dataset_id", F.lit("/meta/episodes.jsonl")).alias("at"), "episode_index", F.to_json(F.struct("episode_index", F.col("n").alias("length"))).alias("line"))
    layouts.write_files(lines, root, F.col("at"), ["at", "episode_index"], lines=True)
    totals = n.groupBy("dataset_id").agg(F.count("*").alias("episodes"), F.sum("n").alias("frames"))
    _objects(totals, root, "info", lambda e, f: _info("v2.1", e, f) | {"total_chunks": -(-e // 50)})
    report = repair_store(spark, root)
    left = layouts.scan_lines(spark, root, "episodes", "episode_index long, length long").groupBy("dataset").agg(F.count("*").alias("_lines"))
    i = layouts.scan_objects(spark, root, "info").select("dataset", F.from_json("body", "total_episodes long, total_frames long").alias("i")).select("dataset", "i.*")
    chunks = layouts.scan_lines(spark, root, "episodes", "episode_index long, length long").groupBy("dataset").agg(F.count_distinct(F.expr("episode_index div 50")).alias("chunks"))
    out = report.join(left, "dataset").where("_lines = kept").drop("_lines").join(i, "dataset").join(chunks, "dataset")
    return out.withColumnRenamed("dataset", "dataset_id")


@query(f"with {RECORDS}, d as (select distinct dataset_id from f), s as (select * from (values ('first', 'arm'), ('first', 'gripper'), ('changed', 'arm'), ('changed', 'gripper')) t(run, key)) select dataset_id, run, key from d, s")
def relative_stats_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Relative statistics by fingerprint: computed for relative keys only, none again, all when the horizon changes (90, 91)."""
    from trajspark.plans.modalities import ActionConfig, ModalityConfig

    caches = f"{shared_folder(spark).rstrip('/')}/relative-{uuid.uuid4().hex}"

    def run(batches):
        for b in batches:
            out = []
            for ds in b.column(0).to_pylist():
                kinds = (ActionConfig("relative"), ActionConfig("absolute"), ActionConfig("relative"))
                path, state = f"{caches}/{ds}/relative_stats.json", ModalityConfig((0,), ("arm", "gripper"))
                for name, deltas in (("first", (0, 1)), ("again", (0, 1)), ("changed", (0, 1, 2))):
                    specs = stats.relative_specs("tag", ModalityConfig(deltas, ("gripper", "base", "arm"), actions=kinds), state)
                    out += [(ds, name, k) for k in stats.refresh_relative(path, specs, lambda k: {"mean": [0.0]})]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["dataset_id", "run", "key"])

    return layouts.scan_objects(spark, _store(spark, folder, "v2"), "info").select("dataset").mapInArrow(run, "dataset_id string, run string, key string")


@query("with a as (select distinct dataset_id, \"key\" as action, case \"key\" when 'arm' then 'gripper' else \"key\" end state from modality where modality = 'action') select a.dataset_id, a.action, a.state, m.\"start\" as \"start\", m.\"end\" as stop from a left join (select distinct * from modality where modality = 'state') m on m.dataset_id = a.dataset_id and m.\"key\" = a.state")
def action_references(spark: SparkSession, folder: str) -> DataFrame:
    """The state slice of each action group, by its own name or another given (76)."""
    from trajspark.operators import joins

    return joins.action_references(table(spark, folder, "modality"), {"arm": "gripper"})


@query(f"""with {RECORDS}, m as (select distinct dataset_id, "key" k, "start" st, "end" en from modality where modality = 'state'),
v as (select f.dataset_id, f.episode_index, f.frame_index, flatten(list(s[st + 1:en]::double[] order by k)) v from f join m using (dataset_id) where s is not null and len(list_filter(s, lambda z: z is null or not isfinite(z) or abs(z) >= 1e6)) = 0 group by all)
select dataset_id, count(*) n, max(len(v)) width, round(sum(list_sum(list_transform(v, lambda z, i: z * i))), 1) weighted from v group by 1""")
def adapted_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Named parts of the state looked up and put together in order of their names (54b, 178)."""
    from trajspark.operators import joins

    rows = frame_records(table(spark, folder, "frames"), "observation.state").where("state is not null and forall(state, x -> x is not null and not isnan(x) and abs(x) < 1e6)")
    out = joins.adapted_input(rows, "state", table(spark, folder, "modality"))
    weighted = F.aggregate(F.transform("input", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda t, x: t + x)
    return out.groupBy("dataset_id").agg(F.count("*").alias("n"), F.max(F.size("input")).alias("width"), F.round(F.sum(weighted), 1).alias("weighted"))


@query(f"with {RECORDS}, per as (select dataset_id, episode_index, count(*) n from f group by all), k as (select dataset_id, unnest(['start', 'step', 'end']) kind, unnest([1, n, 1]) c from per) select dataset_id, kind, sum(c)::bigint n from k group by all")
def episode_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of an episode to a processor: start, a step per frame, end; each handed over alone (151)."""
    from pyspark.sql import Window

    rows = frame_records(table(spark, folder, "frames"))
    w = Window.partitionBy(*EPISODE)
    ends = rows.withColumn("a", F.min("frame_index").over(w)).withColumn("b", F.max("frame_index").over(w))
    kinds = ends.select("dataset_id", F.explode(texts.message_kinds(F.col("frame_index") == F.col("a"), F.col("frame_index") == F.col("b"))).alias("kind"))
    return kinds.withColumn("kind", texts.only_message(F.array("kind"))).groupBy("dataset_id", "kind").agg(F.count("*").alias("n"))


@query("with e as (select event_id, user_id % 4 as rank, value from events), o as (select rank, avg(value) own from e group by 1) select rank, round(own, 6) own, round((select avg(own) from o), 6) mean, (select arg_min(own, rank) from o) >= 10 go_on from o")
def rank_means(spark: SparkSession, folder: str) -> DataFrame:
    """A metric's mean over ranks and the first rank's decision, as every rank is told (210)."""
    from trajspark.operators import evaluation

    e = table(spark, folder, "events").withColumn("rank", F.col("user_id") % 4)
    out = evaluation.across_ranks(e, "rank", "value", 10.0)
    return out.select("rank", F.round("own", 6).alias("own"), F.round("mean", 6).alias("mean"), "go_on")


@query("with b as (select event_type, event_id // 100 batch, count(*) filter (value > 20) correct, count(*) total from events group by all), r as (select event_type, batch, (sum(correct) over w)::bigint correct, (sum(total) over w)::bigint total from b window w as (partition by event_type order by batch)) select event_type, batch, correct, total, round(correct / total, 6) accuracy from r")
def running_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Counters carried over batches (185)."""
    from trajspark.operators import evaluation

    b = table(spark, folder, "events").groupBy("event_type", F.expr("event_id div 100").alias("batch")).agg(F.count_if(F.col("value") > 20).alias("correct"), F.count("*").alias("total"))
    return evaluation.running_accuracy(b, ["event_type"], "batch").withColumn("accuracy", F.round("accuracy", 6))


@query("select user_id, count(*) n, count(*) filter (event_type = 'error') errors, round(sum(case when event_type = 'error' then value end), 4) error_value, count(*) filter (event_type <> 'error') others from events group by 1")
def ragged_infos(spark: SparkSession, folder: str) -> DataFrame:
    """Infos whose keys differ from row to row, read into one layout with nulls where a key is missing (181)."""
    e = table(spark, folder, "events")
    body = F.when(F.col("event_type") == "error", F.to_json(F.struct("user_id", F.struct("value").alias("error")))).otherwise(F.to_json(F.struct("user_id", F.lit(True).alias("fine"))))
    i = e.select(F.from_json(body, "user_id bigint, error struct<value: double>, fine boolean").alias("i")).select("i.*")
    return i.groupBy("user_id").agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.round(F.sum("error.value"), 4).alias("error_value"), F.count("fine").alias("others"))


@query("""with x as (select vec_id, list_transform(embedding, lambda z: floor(greatest(0, least(1, z::double)) * 255)::int) p from embeddings), y as (select vec_id, unnest(range(16)) i, p from x),
z as (select vec_id, i // 4 r, i % 4 c, p from y), m as (select vec_id, r, c, round_even((p[r * 16 + c * 2 + 1] + p[r * 16 + c * 2 + 2] + p[r * 16 + 8 + c * 2 + 1] + p[r * 16 + 8 + c * 2 + 2]) / 4.0, 0)::int v from z)
select vec_id, sum(v * (r * 4 + c + 1))::bigint halved from m group by 1""")
def image_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation pipeline: the whole picture, halved by interpolation (157, 158)."""
    kernel = images.evaluation_pipeline(1.0, 4, 4)
    e = table(spark, folder, "embeddings")

    def run(batches):
        for b in batches:
            ys = [kernel(images.to_uint8(np.asarray(v, np.float64).reshape(8, 8, 1)), None)[..., 0].astype(np.int64) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int((y.ravel() * (np.arange(16) + 1)).sum()) for y in ys], pa.int64())], names=["vec_id", "halved"])

    return e.select("vec_id", "embedding").mapInArrow(run, f"vec_id {dict(e.dtypes)['vec_id']}, halved long")


@query(f"""with {RECORDS}, g as (select dataset_id, episode_index, frame_index, floor((ts - 0.05) / 0.1 + 0.00001)::bigint g, ts from f),
b as (select *, coalesce(greatest(max(g) over (partition by dataset_id, episode_index order by ts, frame_index rows between unbounded preceding and 1 preceding) + 1, 0), 0) s from g where g >= 0)
select dataset_id, episode_index, unnest(range(s, g + 1)) slot, frame_index from b where g >= s""")
def resample_continued(spark: SparkSession, folder: str) -> DataFrame:
    """The grid filled row by row, the next slot to fill being all that is kept in between (182)."""
    from trajspark.streaming import scans

    rows = frame_records(table(spark, folder, "frames"), "timestamp").withColumn("ts", F.col("ts").cast("double")).where("ts is not null")
    step = scans.resample([*EPISODE, "frame_index"], "ts", 0.05, 0.1)
    return scans.batch_scan(rows, EPISODE, ["ts", "frame_index"], step, "dataset_id string, episode_index long, slot long, frame_index long", ["dataset_id", "episode_index", "slot", "frame_index"])
