"""Writing data sets: one file per path named by the rows, and whole stores of both layouts.

All writers are distributed: rows of a path come to one task in order and are written as they come,
so a file of any size needs the memory of a batch. A file appears under its name only when whole.
"""

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.plans.files import opened
from trajspark.plans.shared import cut
from trajspark.plans.sizes import partitions_for

_WRITTEN = pa.schema([("path", pa.string()), ("n_rows", pa.int64())])


class _Parquet:
    def __init__(self, stream, schema: pa.Schema):
        self.w = pq.ParquetWriter(stream, schema, store_schema=False)

    def add(self, rows: pa.RecordBatch) -> None:
        self.w.write_batch(rows)

    def close(self) -> None:
        self.w.close()


class _Lines:
    def __init__(self, stream, schema: pa.Schema):
        self.stream = stream

    def add(self, rows: pa.RecordBatch) -> None:
        self.stream.write("".join(f"{x}\n" for x in rows.column(0).to_pylist()).encode())

    def close(self) -> None:
        pass


def _writer(root: str, kind: type, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        path = stream = sink = part = None
        n, done = 0, []

        def close():
            sink.close()
            stream.close()
            fs.move(part, f"{base}/{path}")
            done.append((path, n))

        for b in batches:
            names = b.column(0).to_pylist()
            rows = pa.RecordBatch.from_arrays(b.columns[1:], names=columns)
            at = 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if names[at] != path:
                    if path is not None:
                        close()
                    path, n = names[at], 0
                    folder = f"{base}/{path}".rpartition("/")[0]
                    fs.create_dir(folder, recursive=True)
                    part = f"{folder}/_{uuid.uuid4().hex}.tmp"
                    stream = fs.open_output_stream(part)
                    sink = kind(stream, rows.schema)
                sink.add(rows.slice(at, end - at))
                n += end - at
                at = end
        if path is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _WRITTEN)], schema=_WRITTEN)

    return run


def write_files(rows: DataFrame, root: str, path: Column, order: list[str], lines: bool = False) -> DataFrame:
    """One file under `root` per distinct value of `path` (relative), its rows in `order`: (path, n_rows), stored.

    Parquet with all columns of `rows`, or with `lines` the text of its only other column. Rows whose
    path is null are left out. Existing files of the same paths are replaced.
    """
    columns = [c for c in rows.columns if not (lines and c in order)] if lines else rows.columns
    named = rows.select(path.alias("_path"), *[F.col(f"`{c}`") for c in rows.columns]).where("_path is not null")
    named = named.repartition(partitions_for(rows), "_path").sortWithinPartitions("_path", *[F.col(f"`{c}`") for c in order])
    plain = named.select("_path", *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    return cut(plain.mapInArrow(_writer(root, _Lines if lines else _Parquet, columns), "path string, n_rows long"))


def scan_files(spark: SparkSession, root: str, part: str = "data") -> DataFrame:
    """The Parquet rows below `part` of every data set under `root`, with `dataset`, its folder's name."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/*/{part}")
    return df.withColumn("dataset", F.regexp_extract(F.col("_metadata.file_path"), f"/([^/]+)/{part}/", 1))


def scan_lines(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The JSON lines of a metadata file of every data set under `root`, with `dataset`; blank lines are passed over."""
    df = spark.read.schema(schema).json(f"{root}/*/meta/{name}.jsonl")
    key = schema.split()[0]
    return df.withColumn("dataset", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/meta/", 1)).where(F.col(key).isNotNull())


def scan_objects(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(dataset, body): a metadata file of every data set under `root` as JSON text."""
    df = spark.read.text(f"{root}/*/meta/{name}.json", wholetext=True)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/meta/", 1).alias("dataset"), F.col("value").alias("body"))


def episode_slices(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """(dataset, episode_index, n_slice, n_rows, fallback) of episodes stored as row ranges of shared files.

    frames: dataset, episode_index, path, row (its number within the file); episodes: dataset,
    episode_index, path, from, to, numbered through the data set; a file begins at its least `from`.
    A slice that is short or holds rows of another episode is no slice of it (`fallback`): then, as
    always, the rows whose episode_index says so are the episode's, n_rows of them.
    """
    base = episodes.groupBy("dataset", "path").agg(F.min("from").alias("_base"))
    spans = episodes.join(base, ["dataset", "path"]).select("dataset", F.col("episode_index").alias("_e"), "path", (F.col("from") - F.col("_base")).alias("_lo"), (F.col("to") - F.col("_base")).alias("_hi"))
    # each row meets the spans of its block of rows by equality
    blocks = spans.where("_hi > _lo").withColumn("_b", F.explode(F.sequence(F.expr("_lo div 4096"), F.expr("(_hi - 1) div 4096"))))
    met = frames.withColumn("_b", F.expr("row div 4096")).join(blocks, ["dataset", "path", "_b"]).where("row >= _lo and row < _hi")
    inside = met.groupBy("dataset", F.col("_e").alias("episode_index")).agg(F.count("*").alias("n_slice"), F.count_if(F.col("episode_index") != F.col("_e")).alias("_others"))
    own = frames.groupBy("dataset", "episode_index").agg(F.count("*").alias("n_rows"))
    out = episodes.select("dataset", "episode_index", (F.col("to") - F.col("from")).alias("_n")).join(inside, ["dataset", "episode_index"], "left").join(own, ["dataset", "episode_index"], "left").fillna(0, ["n_slice", "n_rows", "_others"])
    return out.select("dataset", "episode_index", "n_slice", "n_rows", ((F.col("n_slice") < F.col("_n")) | (F.col("_others") > 0)).alias("fallback"))
