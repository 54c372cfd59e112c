"""Frame records cut into pieces: bounded runs of whole episodes that one task works through.

A piece is (data set, episode range, frame block). Small data sets are one piece, large ones are
many, a very long episode is several, so no key needs more than one bounded piece in memory.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.plans.sizes import partitions_for, small_side

KEYS = ("dataset_id", "episode_index", "frame_index")


def _thin(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops rows whose record was already seen in the batch: hot repeats stay on the map side."""
        for b in batches:
            n = b.num_rows
            if n < 2:
                yield b
                continue
            ids = b.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            e = b.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            f = b.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
            same = (ids[1:] == ids[:-1]) & (e[1:] == e[:-1])
            if np.all(~same | (f[1:] > f[:-1])) and np.all(same | ((ids[1:] > ids[:-1]) | ((ids[1:] == ids[:-1]) & (e[1:] > e[:-1])))):
                yield b  # strictly ascending: nothing repeats
                continue
            order = np.lexsort((f, e, ids))
            i, x, y = ids[order], e[order], f[order]
            new = np.r_[True, (i[1:] != i[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            yield b if new.all() else b.take(pa.array(np.sort(order[new])))

    return run


def frame_pieces(
    frames: DataFrame,
    vectors: list[Column],
    names: list[str],
    episodes: int = 64,
    block: int = 16384,
    before: int = 0,
    after: int = 0,
    more: DataFrame | None = None,
) -> DataFrame:
    """Rows (dataset_id, piece, block, episode_index, frame_index, *names), sorted within partitions.

    The columns of `more` (dataset_id, ..), one row a data set, are added to every row, null where it lacks one.

    `piece` is episode_index div `episodes`, `block` is frame_index div `block`. Rows within
    `before` frames ahead of a block or `after` frames behind it are copied into that block too.
    Rows with a null key are no frame records and are left out. Repeats within a batch are dropped
    before the shuffle; the reader of a piece must still drop adjacent repeats.
    """
    slim = frames.select(*KEYS, *[v.alias(n) for v, n in zip(vectors, names)]).where(
        F.col("dataset_id").isNotNull() & F.col("episode_index").isNotNull() & F.col("frame_index").isNotNull()
    )
    slim = slim.mapInArrow(_thin(len(names)), slim.schema)
    at = F.expr(f"frame_index div {block}")
    blocks = F.array(at)
    if after:
        blocks = F.when(F.expr(f"frame_index >= {block} and frame_index % {block} < {after}"), F.array(at - 1, at)).otherwise(blocks)
    if before:
        blocks = F.when(F.expr(f"frame_index % {block} >= {block - before}"), F.concat(blocks, F.array(at + 1))).otherwise(blocks)
    piece = F.expr(f"episode_index div {episodes}")
    added: list[str] = []
    if more is not None:
        slim = slim.join(small_side(more), "dataset_id", "left")
        added = [c for c in more.columns if c != "dataset_id"]
    return (
        slim.select("dataset_id", piece.cast("bigint").alias("piece"), F.explode(blocks).alias("block"), "episode_index", "frame_index", *names, *added)
        .repartition(partitions_of(frames), "dataset_id", "piece", "block")
        .sortWithinPartitions("dataset_id", "piece", "block", "episode_index", "frame_index")
    )


def partitions_of(frames: DataFrame) -> int:
    """Partitions of the pieces of `frames`: by the stored bytes of its vectors, so that tasks stay alike however many frames there are."""
    stored = [c for c in (*KEYS, "observation.state", "action") if c in frames.columns]
    return partitions_for(frames.select(*[F.col(f"`{c}`") for c in stored]))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first `keys` columns, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for i in range(keys):
            c = b.column(i)
            if b.num_rows > 1:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        first = tuple(b.column(i)[0].as_py() for i in range(keys))
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for k in range(len(cuts) - 1):
            if cuts[k + 1] == cuts[k]:
                continue
            if held and (k > 0 or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(cuts[k], cuts[k + 1] - cuts[k]))
        last = tuple(b.column(i)[b.num_rows - 1].as_py() for i in range(keys))
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values as double, rows by the widest vector; which rows have a vector). Missing places are NaN."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], column.type)
    there = a.is_valid().to_numpy(zero_copy_only=False)
    width = pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(width.max()) if len(width) else 0
    flat = a.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    out = np.full((len(a), wide), np.nan)
    if wide:
        out[np.arange(wide)[None, :] < width[:, None]] = values
    return out, there


def distinct_rows(t: pa.Table) -> np.ndarray:
    """Positions of the first row of each (episode_index, frame_index) in a sorted piece."""
    e, f = (t.column(n).to_numpy() for n in ("episode_index", "frame_index"))
    return np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (f[1:] != f[:-1])]) if len(e) else np.zeros(0, int)
