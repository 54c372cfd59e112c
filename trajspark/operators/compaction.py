"""Far too many small files: what each contributes, and consolidation by copying blocks.

The plan comes first: per file and episode one bitmap of the frames it holds, built on the map
side, so that a file of thousands of rows is one short row in the shuffle. Walking the files in
order of arrival, a file contributes the frames no earlier file held. Files that contribute all
their rows are copied block by block, files that contribute nothing are dropped, and only files
that contribute part of their rows are decoded and rewritten. The account of a consolidation says
for every file where its blocks or rows went.
"""

import hashlib
import io
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.functions.paths import plain_path
from trajspark.plans.files import opened
from trajspark.plans.pieces import groups, partitions_of
from trajspark.plans.shared import cut
from trajspark.plans.sizes import by_shuffle
from trajspark.sources.parquet_blocks import concat_files, read_footer


def contributions(frames: DataFrame, files: DataFrame) -> DataFrame:
    """Per listed data file: (dataset_id, data_path, received_at, n_rows, n_frames, n_new).

    n_rows counts stored rows, n_frames distinct frame records, n_new those that no file of the data
    set received earlier (ties: smaller path) holds. A file listed several times counts as first
    received. Paths are compared without ./ and doubled slashes and given in that plain form. Rows
    whose file is not listed, and rows with a null key, contribute nothing; a file without rows has 0.
    """
    listed = (
        files.where("kind = 'data' and dataset_id is not null and path is not null")
        .groupBy("dataset_id", plain_path(F.col("path")).alias("data_path"))
        .agg(F.min("received_at").alias("received_at"))
    )
    held = (
        frames.where("dataset_id is not null and episode_index is not null and frame_index is not null and data_path is not null")
        .groupBy("dataset_id", plain_path(F.col("data_path")).alias("data_path"), "episode_index", F.expr("bitmap_bucket_number(frame_index + 1)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(frame_index + 1))").alias("bits"), F.count("*").alias("n_rows"))
    )
    order = Window.partitionBy("dataset_id", "episode_index", "bucket").orderBy("received_at", "data_path")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.join(by_shuffle(listed), ["dataset_id", "data_path"]).withColumn("n_seen", F.bitmap_count(F.bitmap_or_agg("bits").over(so_far)))
    per_file = (
        ranked.withColumn("n_new", F.col("n_seen") - F.coalesce(F.lag("n_seen").over(order), F.lit(0)))
        .groupBy("dataset_id", "data_path")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum(F.bitmap_count("bits")).alias("n_frames"), F.sum("n_new").alias("n_new"))
    )
    return listed.join(by_shuffle(per_file), ["dataset_id", "data_path"], "left").fillna(0, ["n_rows", "n_frames", "n_new"])


def treatment(plan: DataFrame) -> DataFrame:
    """How the consolidation treats each file: drop, copy (all rows are new records) or rewrite."""
    return plan.withColumn("treatment", F.when(F.col("n_new") == 0, "drop").when(F.col("n_new") == F.col("n_rows"), "copy").otherwise("rewrite"))


#: Outputs whose files one task puts in order.
OUTPUTS_A_RANGE = 8


def binned(files: DataFrame, total: int, target: int, keys: list[str], name: str) -> DataFrame:
    """Adds `bin`: files (keys, name, n_bytes) cut wherever the running size in order of name passes `target`.

    The running sum is kept per hash range of `keys`, which say what lies together; there are as many
    ranges as `total` bytes hold eight outputs, so a task orders the files of about eight outputs
    however many there are. A bin never spans two ranges.
    """
    ranges = max(1, -(-total // (OUTPUTS_A_RANGE * target)))
    w = Window.partitionBy("_range").orderBy(*keys, name)
    before = F.sum("n_bytes").over(w) - F.col("n_bytes")
    ranged = files.withColumn("_range", F.pmod(F.xxhash64(*keys), F.lit(ranges)))
    return ranged.withColumn("bin", F.format_string("%06d-%06d", F.col("_range"), F.floor(before / F.lit(target)))).drop("_range")


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("path", "n_bytes", "n_rows", "n_blocks", "schema_id")}
        for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fs, at = opened(path)
            with fs.open_input_file(at) as f:
                foot = read_footer(f)
            for k, v in zip(out, (path, size, foot.rows, len(foot.groups), hashlib.sha256(foot.schema + foot.pairs).hexdigest()[:16])):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("n_rows", pa.int64()), ("n_blocks", pa.int64()), ("schema_id", pa.string())]))


_DONE = pa.schema([("out_path", pa.string()), ("n_files", pa.int64()), ("n_rows", pa.int64()), ("n_blocks", pa.int64()), ("n_bytes", pa.int64()), ("ok", pa.bool_())])


def _sources(paths: list[str], earlier: list[list | None], left: list[int]) -> Iterator:
    """The files one after the other, open; those with `earlier` decoded and written anew with only their new rows.

    A rewritten file must have as many rows as are `left` of it.
    """
    for path, seen, n in zip(paths, earlier, left):
        fs, at = opened(path)
        with fs.open_input_file(at) as f:
            if seen is None:
                yield f
                continue
            t = pq.read_table(f)
            have = {(s["episode_index"], s["bucket"]): s["earlier"] for s in seen}
            mask, held = [], set()
            for k in zip(t.column("episode_index").to_pylist(), t.column("frame_index").to_pylist()):
                bits, x = have.get((k[0], k[1] // SPAN)), k[1] % SPAN
                new = k not in held and not (bits and bits[x // 8] >> x % 8 & 1)
                held.add(k)
                mask.append(new)
            t = t.filter(pa.array(mask))
            if t.num_rows != n:
                raise ValueError(f"{path}: {t.num_rows} rows are left, {n} expected")
            again = io.BytesIO()
            pq.write_table(t, again, **OPTIONS)
            again.seek(0)
            yield again


def _copy(folder: str):
    """Puts the files of each bin together: (bin, paths, earlier, rows, blocks) to one row of _DONE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in _DONE.names}
            for i in range(b.num_rows):
                name, files, rows, blocks = (b.column(k)[i].as_py() for k in range(4))
                fs, root = opened(folder)
                fs.create_dir(root, recursive=True)
                # a name of its own per attempt, moved into place when whole: a repeated or
                # speculative task can neither double rows nor leave half a file
                final, part = f"{root}/{name}.parquet", f"{root}/_{name}.{uuid.uuid4().hex}"
                files.sort(key=lambda f: f["path"])
                with fs.open_output_stream(part) as target:
                    done = concat_files(_sources([f["path"] for f in files], [f["earlier"] for f in files], [f["n_left"] for f in files]), target)
                with fs.open_input_file(part) as f:
                    check = pq.ParquetFile(f).metadata
                    whole = (check.num_rows, check.num_row_groups) == (rows, blocks) == (done["rows"], done["blocks"])
                if not whole:
                    fs.delete_file(part)
                    raise ValueError(f"{name}: {check.num_rows} rows in {check.num_row_groups} blocks, {rows} in {blocks} expected")
                fs.move(part, final)
                for k, v in zip(out, (final, len(files), done["rows"], done["blocks"], done["bytes"], whole)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_DONE)

    return run


_DONE_DDL = "out_path string, n_files long, n_rows long, n_blocks long, n_bytes long, ok boolean"
_EARLIER = "array<struct<episode_index:bigint,bucket:bigint,earlier:binary>>"


def _carried_out(files: DataFrame, folder: str, target: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(outputs, files with `bin`) of copying files (schema_id, path, n_bytes, n_left, n_blocks, earlier, keys).

    As many tasks as outputs. Both are stored, so that nothing is copied twice.
    """
    total = files.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    files = cut(binned(files, total, target, keys, "path").withColumn("bin", F.concat_ws("-", "schema_id", "bin")))
    jobs = cut(files.groupBy("bin").agg(F.collect_list(F.struct("path", "earlier", "n_left")).alias("files"), F.sum("n_left").alias("n_rows"), F.sum("n_blocks").alias("n_blocks")))
    n = jobs.count()
    done = jobs.repartition(max(1, n)).mapInArrow(_copy(folder), _DONE_DDL)
    return cut(done), files


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n_bytes) of the Parquet files under `folder`; names that begin with _ or . are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return found.select("path", F.col("length").alias("n_bytes"))


def compact(files: DataFrame, folder: str, target: int = 128 << 20) -> DataFrame:
    """Copies the Parquet files of `files` (path, n_bytes) into files of about `target` bytes in `folder`.

    Files of one schema are put together in path order, without decoding; each output is read back
    and must have the row and block totals of its inputs. Result: (out_path, n_files, n_rows,
    n_blocks, n_bytes, ok), stored, with one task an output. Files that aren't whole raise an error
    rather than being left out. The list of paths of one output is bounded by `target` over the
    smallest file size there is.
    """
    foot = cut(files.select("path", "n_bytes").mapInArrow(_footers, "path string, n_bytes long, n_rows long, n_blocks long, schema_id string"))
    rows = foot.withColumnRenamed("n_rows", "n_left").withColumn("earlier", F.lit(None).cast(_EARLIER)).withColumn("_at", F.regexp_replace("path", "[^/]*$", ""))
    return _carried_out(rows, folder, target, ["schema_id", "_at"])[0]


KEYS = ["dataset_id", "episode_index", "frame_index"]


def listed_files(files: DataFrame) -> DataFrame:
    """(dataset_id, file, listed_at): data files by plain path, as first received."""
    return (
        files.where("kind = 'data' and dataset_id is not null and path is not null")
        .groupBy("dataset_id", plain_path(F.col("path")).alias("file"))
        .agg(F.min("received_at").alias("listed_at"))
    )


def _bitmaps(rows: DataFrame, *keys: str) -> DataFrame:
    """Per `keys`, episode and bucket of frame indexes: the bitmap of the frames held and the rows."""
    return rows.groupBy(*keys, "episode_index", F.expr("bitmap_bucket_number(frame_index + 1)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(frame_index + 1))").alias("bits"), F.count("*").alias("n_rows")
    )


#: Frames of one bitmap, and how the files stored here are encoded.
SPAN = 32768
OPTIONS = {"compression": "zstd", "store_schema": False, "use_dictionary": ["dataset_id", "data_path"], "write_statistics": ["dataset_id", "episode_index", "frame_index"]}

_STORED = pa.schema([("dataset_id", pa.string()), ("file", pa.string()), ("piece", pa.int64()), ("bucket", pa.int64()), ("path", pa.string()), ("n_bytes", pa.int64()), ("n_blocks", pa.int64()), ("schema_id", pa.string())])
PART = ["dataset_id", "file", "piece", "bucket"]


def _named(frames: DataFrame) -> DataFrame:
    """The rows that are frame records as (dataset_id, file, piece, bucket, row): `file` is the plain path of the
    file they were stored in ('' for none), `row` all their columns, whatever these are called."""
    rows = frames.where(" and ".join(f"{k} is not null" for k in KEYS))
    row = F.struct(*[F.col(f"`{c}`") for c in frames.columns])
    return rows.select("dataset_id", F.coalesce(plain_path(F.col("data_path")), F.lit("")).alias("file"), F.expr("episode_index div 64").alias("piece"), F.shiftright("frame_index", 15).alias("bucket"), row.alias("row"))


def _store(folder: str):
    """Writes each run of equal (data set, file, piece, bucket) as a Parquet file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        fs, root = opened(folder)
        made: set[str] = set()
        for t in groups(batches, 4):
            ds, file, piece, bucket = (t.column(i)[0].as_py() for i in range(4))
            b = io.BytesIO()
            row = t.column(4).combine_chunks()
            row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
            pq.write_table(pa.Table.from_arrays(row.flatten(), names=[f.name for f in row.type]), b, **OPTIONS)
            foot, data = read_footer(b), b.getvalue()
            # a name of its own per attempt; only attempts that succeed are listed
            at = f"{root}/{urllib.parse.quote(ds, safe='')}"
            if at not in made:
                fs.create_dir(at, recursive=True)
                made.add(at)
            path = f"{at}/{uuid.uuid4().hex}.parquet"
            with fs.open_output_stream(path) as f:
                f.write(data)
            rows.append((ds, file, piece, bucket, path, len(data), len(foot.groups), hashlib.sha256(foot.schema + foot.pairs).hexdigest()[:16]))
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STORED)], schema=_STORED)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STORED)], schema=_STORED)

    return run


def stored_small_files(frames: DataFrame, folder: str) -> DataFrame:
    """The small files that the rows of `frames` were read from, written to `folder`: one row a file, stored.

    A file holds the rows of one data_path, with all their columns; one of many episodes or frames
    is stored in parts (64 episodes, 32,768 frames), so that no task holds more than such a part.
    Result: (dataset_id, file, piece, bucket, path, n_bytes, n_blocks, schema_id).
    """
    n = partitions_of(frames)
    order = [*PART, "row.episode_index", "row.frame_index"] + [f"row.{c}" for c in ("received_at",) if c in frames.columns]
    rows = _named(frames).repartition(n, *PART).sortWithinPartitions(*order)
    ddl = "dataset_id string, file string, piece long, bucket long, path string, n_bytes long, n_blocks long, schema_id string"
    return cut(rows.mapInArrow(_store(folder), ddl))


def part_plan(frames: DataFrame, files: DataFrame) -> DataFrame:
    """What each part of each file gives: (dataset_id, file, piece, bucket, n_rows, n_left, treatment, earlier).

    As in `contributions`, a record stays in the file that was received first; files that aren't listed
    (or rows without a path) come last, so that records held only there are kept too. `n_left` are the
    new records. A part to rewrite names the frames of its episodes that earlier files hold.
    """
    rows = _named(frames.select(*KEYS, "data_path")).select(*PART, "row.episode_index", "row.frame_index")
    held = (
        rows.groupBy(*PART, "episode_index")
        .agg(F.expr(f"bitmap_construct_agg(frame_index - bucket * {SPAN})").alias("bits"), F.count("*").alias("n_rows"))
        .join(by_shuffle(listed_files(files)), ["dataset_id", "file"], "left")
    )
    order = Window.partitionBy("dataset_id", "episode_index", "bucket").orderBy(F.col("file") == "", F.isnull("listed_at"), "listed_at", "file")
    earlier = F.expr("bitmap_or_agg(bits)").over(order.rowsBetween(Window.unboundedPreceding, -1))
    upto = F.bitmap_count(F.expr("bitmap_or_agg(bits)").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranked = held.withColumn("earlier", earlier).withColumn("n_new", upto - F.coalesce(F.bitmap_count("earlier"), F.lit(0))).drop("bits")
    # what passes as it is, or not at all, needs no bitmap further on
    partly = (F.col("n_new") < F.col("n_rows")) & (F.col("n_new") > 0) | (F.col("n_new") == 0)
    seen = F.collect_list(F.when(partly & F.col("earlier").isNotNull(), F.struct("episode_index", "bucket", "earlier")))
    per = ranked.groupBy(*PART).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_new").alias("n_left"), seen.alias("earlier"))
    per = treatment(per.withColumnRenamed("n_left", "n_new")).withColumnRenamed("n_new", "n_left")
    return per.withColumn("earlier", F.when(F.col("treatment") == "rewrite", F.col("earlier")))


def n_records(frames: DataFrame) -> tuple[int, int]:
    """(rows, distinct frame records) of the rows that are frame records."""
    rows = frames.where(" and ".join(f"{k} is not null" for k in KEYS))
    r = _bitmaps(rows, "dataset_id").agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()
    return r[0], r[1]


def consolidate(frames: DataFrame, files: DataFrame, folder: str, target: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """Carries out the plan: files of about `target` bytes in `folder` that hold every frame record exactly once.

    The small files are rows of `frames` here and are written out first, beside `folder`. Of these, files
    to copy go into the outputs block by block, files to rewrite are decoded and give their new rows,
    files to drop give nothing. Rows and blocks of every output, and at last the distinct records of all
    of them, are counted again; if they aren't those planned it is an error. Returns the outputs, as
    `compact`, and the account: (dataset_id, file, piece, bucket, n_rows, n_left, treatment, out_path),
    one row per stored part, out_path null for what was dropped.
    """
    spark = frames.sparkSession
    plan = cut(part_plan(frames, files))
    stored = stored_small_files(frames, f"{folder}-small")
    parts = plan.join(by_shuffle(stored), PART)  # bitmaps compress: never broadcast by the size of their files
    taken = parts.where("treatment <> 'drop'").withColumn("n_blocks", F.when(F.col("treatment") == "copy", F.col("n_blocks")).otherwise(1))
    done, placed = _carried_out(taken, folder, target, ["schema_id", "dataset_id", "piece"])
    want = plan.agg(F.coalesce(F.sum("n_left"), F.lit(0))).first()[0]
    got = n_records(spark.read.schema(frames.schema).parquet(folder)) if want else (0, 0)
    if got != (want, want):
        raise ValueError(f"{want} frame records, but {got[0]} rows with {got[1]} frame records in the consolidated files")
    root = opened(folder)[1]
    account = plan.drop("earlier").join(by_shuffle(placed.select(*PART, F.concat(F.lit(f"{root}/"), "bin", F.lit(".parquet")).alias("out_path"))), PART, "left")
    return done, account
