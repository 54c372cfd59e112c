"""A Python data source for .npy and .npz files: masks, raw videos and initial actions."""

import glob
import io
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trajspark.plans import files

SEPARATOR = "::"


def load_array(path: str) -> np.ndarray:
    """The array of a file: .npy, or .npz with arr_0 or a single array. Two dimensions become three."""
    if path.endswith(".npy"):
        a = np.load(path, allow_pickle=False)
    elif path.endswith(".npz"):
        with np.load(path, allow_pickle=False) as z:
            if "arr_0" in z.files:
                a = z["arr_0"]
            elif len(z.files) == 1:
                a = z[z.files[0]]
            else:
                raise ValueError(f"{path} holds {len(z.files)} arrays and no arr_0")
    else:
        raise ValueError(f"{path}: only .npy and .npz are read")
    return a[None] if a.ndim == 2 else a


#: Files and stored bytes read by one task.
FILES_A_TASK, BYTES_A_TASK = 256, 16 << 20

#: Values of one batch that is handed on; a single larger frame is a batch of its own.
BATCH_BYTES = 4 << 20

_ROW = pa.schema([("path", pa.string()), ("frame", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("dtype", pa.string()), ("data", pa.binary())])


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _shared_out(paths: list[str], sizes: list[int]) -> list[_Files]:
    """The files in order, as many to a task as its bounds allow, one at least."""
    out, held, total = [], [], 0
    for path, size in zip(paths, sizes):
        if held and (len(held) == FILES_A_TASK or total + size > BYTES_A_TASK):
            out.append(_Files(held))
            held, total = [], 0
        held.append(path)
        total += size
    return [*out, _Files(held)] if held else out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.frames = [int(x) for x in options["frames"].split(",")] if options.get("frames") else None

    def partitions(self):
        files = sorted(f for ext in ("npy", "npz") for f in glob.glob(f"{self.path}/**/*.{ext}", recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return _shared_out(files, [os.path.getsize(f) for f in files])

    def read(self, partition):
        rows, held = [], 0
        for path in partition.paths:
            a = load_array(path)
            shape, kind = (a.shape[1:] + (1, 1, 1))[: max(3, a.ndim - 1)], str(a.dtype)
            for i in self.frames if self.frames is not None else range(len(a)):
                if not 0 <= i < len(a):
                    raise IndexError(f"{path} has {len(a)} frames, not frame {i}")
                rows.append((path, i, shape[0], shape[1], shape[2], kind, a[i].tobytes()))
                held += len(rows[-1][-1]) + len(path)
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


class NdarraySource(DataSource):
    """format('ndarray'): one row per frame (path, frame, h, w, c, dtype, data); a task reads as many files as FILES_A_TASK and BYTES_A_TASK allow.

    Option `frames`: comma-separated frame numbers, so that only the frames asked for are handed on.
    """

    @classmethod
    def name(cls):
        return "ndarray"

    def schema(self):
        return "path string, frame int, h int, w int, c int, dtype string, data binary"

    def reader(self, schema):
        return _Reader(self.options)


def read_arrays(spark: SparkSession, path: str, frames: list[int] | None = None) -> DataFrame:
    spark.dataSource.register(NdarraySource)
    r = spark.read.format("ndarray")
    return (r.option("frames", ",".join(map(str, frames))) if frames is not None else r).load(path)


#: The marker's name and the version of the format; a marker's `format` ends in FORMAT.
MARKER, FORMAT, VERSION = "__schema__", ".initial_actions", 1


def save_initial_actions(actions: list[dict[str, dict[str, np.ndarray]]], path: str, owner: str = "trajspark") -> None:
    """Arrays by data set, trajectory and action key as one .npz with a marker of format, version and number of data sets.

    Names may not hold the separator; `owner` begins the marker's format, for readers that ask for their own.
    """
    flat = {}
    for i, d in enumerate(actions):
        for traj, keys in d.items():
            for key, a in keys.items():
                if SEPARATOR in str(traj) or SEPARATOR in key:
                    raise ValueError(f"a name holds {SEPARATOR}")
                flat[SEPARATOR.join((str(i), str(traj), key))] = np.asarray(a)
    marker = {"format": owner + FORMAT, "version": VERSION, "key_sep": SEPARATOR, "num_datasets": len(actions)}
    out = io.BytesIO()
    np.savez(out, **flat, **{MARKER: np.frombuffer(json.dumps(marker).encode(), dtype=np.uint8)})
    files.write(path, out.getvalue())


def read_initial_actions(path: str) -> list[dict[str, dict[str, np.ndarray]]]:
    """What save_initial_actions was given, data sets without actions and the arrays' shapes included.

    Never unpickles. A file without the marker, of another format or version, a broken name and a
    data set beyond their number are errors.
    """
    with np.load(io.BytesIO(files.read(path)), allow_pickle=False) as z:
        if MARKER not in z.files:
            raise ValueError(f"{path}: no {MARKER} marker")
        marker = json.loads(bytes(z[MARKER]))
        if not str(marker.get("format", "")).endswith(FORMAT) or marker.get("version") != VERSION:
            raise ValueError(f"{path}: unknown format {marker}")
        out: list[dict[str, dict[str, np.ndarray]]] = [{} for _ in range(int(marker.get("num_datasets", 0)))]
        for name in z.files:
            if name == MARKER:
                continue
            i, *parts = name.split(SEPARATOR, 2)
            if len(parts) != 2 or not i.isdigit() or int(i) >= len(out):
                raise ValueError(f"{path}: bad name {name}")
            out[int(i)].setdefault(parts[0], {})[parts[1]] = z[name]
    return out


def load_initial_actions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(dataset, trajectory, action_key, row, vec) of saved files; the data sets of several files are numbered on.

    An array of one dimension is one row. The files hold one chunk a trajectory and are read whole.
    """
    rows, base = [], 0
    for path in [paths] if isinstance(paths, str) else paths:
        actions = read_initial_actions(path)
        for d, trajectories in enumerate(actions):
            for traj, keys in trajectories.items():
                for key, a in keys.items():
                    rows += [(base + d, traj, key, i, [float(x) for x in np.ravel(v)]) for i, v in enumerate(np.atleast_2d(a))]
        base += len(actions)
    return spark.createDataFrame(rows, "dataset int, trajectory string, action_key string, row int, vec array<double>")
