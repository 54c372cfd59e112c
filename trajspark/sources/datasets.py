"""Reading stored data sets of both layouts, and rewriting the newer one as the older.

Layout: meta/ (info.json, modality.json, stats, episodes, tasks), data/, videos/, masks/. Before
version 3 there is one Parquet file per episode and JSON lines of metadata; from version 3 on many
episodes share a file and the metadata are Parquet. Both are read by one scan with predicates, so
that columns and row groups are pruned.
"""

import json
import os
import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators.stats import read_json, write_json
from trajspark.plans import files
from trajspark.sources.layouts import write_files

EPISODES = "episode_index long, tasks array<string>, length int, sub_tasks array<struct<start:int,end:int,text:string>>"
TASKS = "task_index long, task string"


def major_version(info: dict) -> int:
    """The number before the first point of the version; 2 if there is none."""
    m = re.search(r"\d+", str(info.get("codebase_version", "v2.1")))
    return int(m.group()) if m else 2


def expand(values: list[str]) -> list[str]:
    """Data set folders from arguments that may be path lists and glob patterns."""
    out = []
    for v in values:
        for part in v.split(os.pathsep):
            out += files.matching(part) if part else []
    return list(dict.fromkeys(out))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(dataset): the folders under `root` that hold meta/info.json."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "info.json").load(root)
    return found.where(F.col("path").rlike("/meta/info\\.json$")).select(F.regexp_replace("path", "/meta/info\\.json$", "").alias("dataset"))


def file_index(spark: SparkSession, root: str, parts: tuple[str, ...] = ("data", "videos", "masks")) -> DataFrame:
    """(path): all files under the parts, relative to the data set; contents aren't read."""
    there = [f"{root}/{p}" for p in parts if files.is_folder(f"{root}/{p}")]
    if not there:
        return spark.createDataFrame([], "path string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    return found.select(F.regexp_extract("path", f"((?:{'|'.join(parts)})/.*)$", 1).alias("path"))


class Dataset:
    """One stored data set; metadata objects are small and read at once, tables on demand."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.info = json.loads(files.read(f"{self.root}/meta/info.json"))
        self.version = major_version(self.info)
        self.modality = read_json(f"{self.root}/meta/modality.json")

    def stats(self, name: str = "stats") -> dict:
        """Published statistics without their fingerprints; {} if there are none."""
        return {k: v for k, v in read_json(f"{self.root}/meta/{name}.json").items() if k != "__fingerprints__"}

    def episodes(self) -> DataFrame:
        """Episode metadata in order, without the embedded statistics of the newer layout."""
        if self.version >= 3:
            if not files.matching(f"{self.root}/meta/episodes/*/*.parquet"):
                raise FileNotFoundError(f"no episode metadata under {self.root}/meta/episodes")
            df = self.spark.read.parquet(f"{self.root}/meta/episodes/*/*.parquet")
            return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("stats/")]).orderBy("episode_index")
        return self.spark.read.schema(EPISODES).json(f"{self.root}/meta/episodes.jsonl").where("episode_index is not null").orderBy("episode_index")

    def tasks(self) -> DataFrame:
        """(task_index, task); the newer layout may keep the text as the table's index."""
        if self.version >= 3:
            df = self.spark.read.parquet(f"{self.root}/meta/tasks.parquet")
            text = "task" if "task" in df.columns else "__index_level_0__"
            return df.select("task_index", F.col(text).alias("task"))
        return self.spark.read.schema(TASKS).json(f"{self.root}/meta/tasks.jsonl").where("task_index is not null")

    def needed_columns(self, groups: dict[str, list[str]] | None = None) -> list[str]:
        """Stored columns that the requested groups (modality: keys) come from, and the frame keys."""
        out = ["episode_index", "frame_index", "timestamp", "task_index"]
        defaults = {"state": "observation.state", "action": "action"}
        for kind, keys in (groups or {k: list(self.modality.get(k, {})) for k in defaults}).items():
            for key in keys:
                spec = self.modality.get(kind, {}).get(key)
                if spec is None and kind != "annotation":
                    raise KeyError(f"{kind}.{key}")
                source = (spec or {}).get("original_key") or defaults.get(kind) or key.replace("annotation.", "")
                if kind != "video" and source not in out:
                    out.append(source)
        return out

    def frames(self, groups: dict[str, list[str]] | None = None, episodes: list[int] | None = None) -> DataFrame:
        """Frame rows with only the needed columns; `episodes` is a predicate on the scan.

        Files without an episode_index column take it from their names.
        """
        df = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{self.root}/data")
        if "episode_index" not in df.columns:
            df = df.withColumn("episode_index", F.regexp_extract("_metadata.file_path", r"episode_(\d+)", 1).cast("bigint"))
        if "frame_index" not in df.columns and "index" in df.columns:
            df = df.withColumn("frame_index", F.col("index"))
        have = [c for c in self.needed_columns(groups) if c in df.columns]
        df = df.select(*[F.col(f"`{c}`") for c in have])
        return df.where(F.col("episode_index").isin(episodes)) if episodes is not None else df

    def groups(self, df: DataFrame, kind: str, strict: bool = True) -> DataFrame:
        """Adds a column `kind.key` per named slice of the modality; with strict=False unknown sources are left out."""
        default = {"state": "observation.state", "action": "action"}.get(kind)
        for key, spec in self.modality.get(kind, {}).items():
            source = spec.get("original_key") or default
            if source not in df.columns:
                if strict:
                    raise KeyError(source)
                continue
            col = F.col(f"`{source}`")
            if df.schema[source].dataType.typeName() == "array" and "start" in spec:
                col = F.slice(col, spec["start"] + 1, spec["end"] - spec["start"])
            df = df.withColumn(f"{kind}.{key}", col)
        return df

    def check_counts(self, frames: DataFrame) -> DataFrame:
        """Episodes whose rows are not as many as the metadata declare: (episode_index, n, expected)."""
        e = self.episodes()
        expected = F.col("dataset_to_index") - F.col("dataset_from_index") if "dataset_to_index" in e.columns else F.col("length")
        n = frames.groupBy("episode_index").agg(F.count("*").alias("n"))
        return e.select("episode_index", expected.alias("expected")).join(n, "episode_index", "full").where("not coalesce(n = expected, false)").select("episode_index", "n", "expected")


def column_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One column of all Parquet files that have it."""
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(folder)
    if name not in df.columns:
        raise KeyError(name)
    return df.select(F.col(f"`{name}`")).where(F.col(f"`{name}`").isNotNull())


def converted_info(info: dict, chunks_size: int) -> dict:
    """info.json of the older layout: version, path patterns and totals; size hints and the rates of
    features other than videos are left out."""
    out = {k: v for k, v in info.items() if k not in ("data_files_size_in_mb", "video_files_size_in_mb")}
    feats = {k: {a: b for a, b in v.items() if a != "fps" or v.get("dtype") == "video"} for k, v in info.get("features", {}).items()}
    videos = sum(v.get("dtype") == "video" for v in feats.values())
    n = int(info.get("total_episodes", 0))
    return out | {
        "codebase_version": "v2.1",
        "chunks_size": chunks_size,
        "total_chunks": -(-n // chunks_size),
        "total_videos": n * videos,
        "features": feats,
        "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet",
        "video_path": "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4" if videos else None,
    }


def nested_stats(row: dict) -> dict:
    """Columns stats/feature/name of an episode's metadata as {feature: {name: value}}."""
    out: dict = {}
    for k, v in row.items():
        if k.startswith("stats/"):
            _, feature, name = k.split("/", 2)
            out.setdefault(feature, {})[name] = v
    return out


def convert(spark: SparkSession, root: str, target: str, chunks_size: int = 1000) -> None:
    """Writes a data set of the newer layout as one of the older: one Parquet file per episode.

    Rows of an episode come to one task, in order, and are written as its file; metadata lines are
    written by one task a file. All is put together in a folder beside `target` that is moved there at
    last, an older `target` being kept under a name of its own. Episodes' embedded statistics go, nested,
    into meta/episodes_stats.jsonl; other files and folders of the data set (images, notes) are copied.
    An empty episode is an error.
    """
    d = Dataset(spark, root)
    if d.version < 3:
        raise ValueError("only data sets of version 3 are converted")
    all_ = spark.read.parquet(f"{d.root}/meta/episodes/*/*.parquet")
    episodes = d.episodes()
    length = F.col("length") if "length" in episodes.columns else F.lit(None).cast("bigint")
    if "dataset_to_index" in episodes.columns:
        length = F.coalesce(length, F.col("dataset_to_index") - F.col("dataset_from_index"))
    episodes = episodes.withColumn("length", length)
    if episodes.where("coalesce(length, 0) <= 0").limit(1).count():
        raise ValueError("an episode has no rows")
    part = f"{target}.{uuid.uuid4().hex}.tmp"
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{d.root}/data")
    path = F.format_string("data/chunk-%03d/episode_%06d.parquet", F.expr(f"episode_index div {chunks_size}"), F.col("episode_index"))
    write_files(rows, part, path, ["episode_index", *(["frame_index"] if "frame_index" in rows.columns else [])])
    keep = [c for c in ("episode_index", "tasks", "length", "sub_tasks") if c in episodes.columns]
    _lines(episodes.select(*keep), part, "episodes", "episode_index")
    _lines(d.tasks(), part, "tasks", "task_index")
    if (nested := _nested_columns(all_.columns)) is not None:
        _lines(all_.select("episode_index", nested), part, "episodes_stats", "episode_index")
    write_json(f"{part}/meta/info.json", converted_info(d.info, chunks_size))
    fs, at = files.opened(d.root)
    for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)):
        name = f.path.removeprefix(at).lstrip("/")
        ours = name.startswith(("data/", "meta/episodes/")) or name in ("meta/info.json", "meta/tasks.parquet")
        if f.type == pafs.FileType.File and not ours:
            files.write(f"{part}/{name}", files.read(f"{d.root}/{name}"))
    fs, at = files.opened(target)
    if files.exists(target):
        fs.move(at, f"{at}.backup-{uuid.uuid4().hex[:8]}")
    fs.move(files.opened(part)[1], at)


def _nested_columns(columns: list[str]):
    """Columns stats/feature/name as one struct `stats` of a struct per feature; None if there are none."""
    by: dict[str, list[str]] = {}
    for c in columns:
        if c.startswith("stats/"):
            by.setdefault(c.split("/", 2)[1], []).append(c)
    return F.struct(*[F.struct(*[F.col(f"`{c}`").alias(c.split("/", 2)[2]) for c in cs]).alias(f) for f, cs in by.items()]).alias("stats") if by else None


def _lines(df: DataFrame, root: str, name: str, order: str) -> None:
    """Metadata rows as the JSON lines of meta/<name>.jsonl, in order."""
    rows = df.select(F.col(order).alias("_order"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("line"))
    write_files(rows, root, F.lit(f"meta/{name}.jsonl"), ["_order"], lines=True)
