"""Video frames by index or time through pluggable decoders.

No codec is bundled. A decoder is a function path -> (frames as array (t, h, w, c), frames per
second); `.npy` stacks are decoded here. Which frames are needed is settled by a join before any
file is opened, and each file is opened once per task.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Decoder = Callable[[str], tuple[np.ndarray, float]]
DECODERS: dict[str, Decoder] = {"npy": lambda p: (np.load(p, allow_pickle=False), 1.0)}

#: Codecs that decode wrongly by index with some backends.
DOUBTFUL = {"av1"}


def register(suffix: str, decoder: Decoder) -> None:
    """A second decoder for a suffix is an error."""
    if suffix in DECODERS:
        raise ValueError(f"there is a decoder for {suffix}")
    DECODERS[suffix] = decoder


def backend_of(path: str, wanted: str | None = None, codec: str | None = None) -> tuple[str, str | None]:
    """(suffix whose decoder is used, warning or None)."""
    name = wanted or path.rsplit(".", 1)[-1]
    if name not in DECODERS:
        raise ValueError(f"no decoder for {name}; known: {', '.join(sorted(DECODERS))}")
    return name, f"{codec} may be decoded wrongly by index" if codec in DOUBTFUL else None


def probe(fps: str, frames: int | None, duration: float | None) -> tuple[float, int]:
    """(frames per second, number of frames) from a fraction, a count or else a duration."""
    a, _, b = fps.partition("/")
    rate = float(a) / float(b or 1)
    return rate, int(frames) if frames is not None else int((duration or 0) * rate)


def frames_at(path: str, index: list[int], decoder: Decoder, missing: str = "error") -> list[np.ndarray]:
    """Frames by number; a missing one is an error, black, or the last frame."""
    stack, _ = decoder(path)
    out = []
    for i in index:
        if 0 <= i < len(stack):
            out.append(stack[i])
        elif missing == "black":
            out.append(np.zeros_like(stack[0]))
        elif missing == "repeat":
            out.append(stack[-1])
        else:
            raise IndexError(f"{path} has {len(stack)} frames, not frame {i}")
    return out


def snap(times: np.ndarray, fps: float, tolerance: float = 0.01) -> np.ndarray:
    """Frame numbers nearest to the times (half to even); off by `tolerance` of a frame or more is an error."""
    k = np.round(np.asarray(times, float) * fps)
    if (np.abs(np.asarray(times) - k / fps) * fps >= tolerance).any():
        raise ValueError("a time does not lie on a frame")
    return k.astype(int)


def addressed(index: Column, from_timestamp: Column, fps: Column) -> Column:
    """A frame's number within a file that holds several episodes: index + round(from * fps), half to even."""
    return index + F.bround(from_timestamp * fps, 0).cast("bigint")


def frame_count(declared: Column, rate: Column, duration: Column) -> Column:
    """The number of frames a container declares, else what its duration and rate hold, cut off."""
    return F.coalesce(declared.cast("bigint"), F.floor(duration * rate).cast("bigint"))


def all_frames(paths: DataFrame, fps: float | None = None, suffix: str | None = None) -> DataFrame:
    """(path, frame, pts, h, w, c, dtype, data) of every frame of the distinct `paths`, pts in seconds from 0.

    `fps` stands in for the decoder's own rate. A file is decoded by one task; frames are handed on one by one.
    """
    decoders = dict(DECODERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                stack, rate = decoders[suffix or p.rsplit(".", 1)[-1]](p.removeprefix("file://"))
                for i in range(0, len(stack), 256):
                    some = stack[i : i + 256]
                    n, x = len(some), some[0]
                    shape = [x.shape[0], x.shape[1], x.shape[2] if x.ndim > 2 else 1]
                    columns = [pa.array([p] * n), pa.array(range(i, i + n), pa.int64()), pa.array([k / (fps or rate) for k in range(i, i + n)], pa.float64()), *[pa.array([d] * n, pa.int32()) for d in shape], pa.array([str(x.dtype)] * n), pa.array([f.tobytes() for f in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "frame", "pts", "h", "w", "c", "dtype", "data"])

    return paths.where("path is not null").select("path").distinct().mapInArrow(run, "path string, frame long, pts double, h int, w int, c int, dtype string, data binary")


def decode(needed: DataFrame, missing: str = "error", suffix: str | None = None) -> DataFrame:
    """(path, frame, h, w, c, dtype, data) of the distinct (path, frame) pairs of `needed`.

    Pairs are brought together by path, so that a file is decoded by one task, once. A path with very
    many frames is cut into ranges of 4,096 frames, each decoded by a task of its own.
    """
    decoders = dict(DECODERS)
    pairs = needed.select("path", "frame").where("path is not null and frame is not null").distinct()
    pairs = pairs.withColumn("span", F.expr("frame div 4096")).repartition("path", "span").sortWithinPartitions("path", "span", "frame").select("path", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stack = None, None
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("path", "frame", "h", "w", "c", "dtype", "data")}
            for p, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != last:
                    last, stack = p, decoders[suffix or p.rsplit(".", 1)[-1]](p.removeprefix("file://"))
                x = frames_at(p, [i], lambda _, s=stack: s, missing)[0]
                for k, v in zip(out, (p, i, x.shape[0], x.shape[1], x.shape[2] if x.ndim > 2 else 1, str(x.dtype), x.tobytes())):
                    out[k].append(v)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return pairs.select("path", F.col("frame").cast("bigint").alias("frame")).mapInArrow(run, "path string, frame long, h int, w int, c int, dtype string, data binary")
