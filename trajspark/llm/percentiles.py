"""Percentiles of state, action and relative action columns from mergeable sketches, and checks of published ones."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.sketch import QuantileSketch
from trajspark.plans.pieces import distinct_rows, frame_pieces, groups, matrix, partitions_of
from trajspark.plans.shared import cut
from trajspark.plans.sizes import at_most

SERIES = ["dataset_id", "modality", "key", "step", "dim"]
FIELDS = (("observation.state", "state"), ("action", "action"))


@dataclass(frozen=True)
class Sizes:
    """Buffer size and buffers of the sketches, frames of a block."""

    size: int = 512
    buffers: int = 6
    block: int = 16384

    def sketch(self) -> QuantileSketch:
        return QuantileSketch(self.size, self.buffers)


_PART = pa.schema([("dataset_id", pa.string()), ("modality", pa.string()), ("key", pa.string()), ("step", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("sketch", pa.binary())])
_PART_DDL = "dataset_id string, modality string, key string, step int, dim int, n long, sketch binary"
_ANSWERS = [f"{q}{x}" for q in ("q01", "q99") for x in ("", "_least", "_most")]
_DDL = "dataset_id string, modality string, key string, step int, dim int, n long, " + ", ".join(f"{a} double" for a in _ANSWERS)


def _relative(spec: str | None) -> list[tuple[str, int, int, int, list[int]]]:
    """The relative series of a data set, written as key:action start:state start:width:steps joined by |."""
    out = []
    for part in (spec or "").split("|"):
        if part:
            key, a, s, w, steps = part.rsplit(":", 4)
            out.append((key, int(a), int(s), int(w), [int(x) for x in steps.split(",")]))
    return out


def series_of(t: pa.Table, block: int) -> Iterator[tuple[str, str, int, int, np.ndarray]]:
    """(modality, key, step, dim, finite values) of each series of one piece."""
    t = t.take(pa.array(distinct_rows(t)))
    ep, fr = t.column("episode_index").to_numpy(), t.column("frame_index").to_numpy()
    own = fr // block == t.column("block")[0].as_py()
    vec = {}
    for key, name in FIELDS:
        vec[name] = matrix(t.column(name))[0]
        v = vec[name][own]
        for d in range(v.shape[1]):
            x = v[:, d]
            x = x[np.isfinite(x)]
            if len(x):
                yield "stats", key, -1, d, x
    spec = _relative(t.column("rel")[0].as_py())
    if spec and len(ep):
        rank = np.cumsum(np.r_[0, (ep[1:] != ep[:-1]).astype(np.int64)])
        span = int(fr.max() - fr.min()) + 2 + max(max(s[4]) for s in spec)
        code = rank * span + (fr - fr.min())
        at = np.flatnonzero(own)
        for key, a, s, w, steps in spec:
            act, state = vec["action"][:, a : a + w], vec["state"][:, s : s + w]
            w = min(act.shape[1], state.shape[1])
            for h in steps:
                j = np.minimum(np.searchsorted(code, code[at] + h), len(code) - 1)
                ok = code[j] == code[at] + h
                diff = act[j[ok]][:, :w] - state[at[ok]][:, :w]
                for d in range(w):
                    x = diff[:, d]
                    x = x[np.isfinite(x)]
                    if len(x):
                        yield "relative_stats", key, h, d, x


def _answers(s: QuantileSketch) -> list[float]:
    return [*s.quantile(0.01), *s.quantile(0.99)]


def _sketch(sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One sketch per data set and series and task."""
        held: dict[tuple, QuantileSketch] = {}
        last = None

        def flush():
            rows = [(last, *k, s.n, s.dump()) for k, s in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PART)], schema=_PART)

        for t in groups(batches, 3):
            source = t.column(0)[0].as_py()
            if source != last and held:
                yield flush()
            last = source
            for modality, key, step, dim, x in series_of(t, sizes.block):
                if (k := (modality, key, step, dim)) not in held:
                    held[k] = sizes.sketch()
                held[k].add(x)
        if held:
            yield flush()

    return run


def _merge(final: bool):
    """Merges the sketches of each series; rows come sorted by series, so that one sketch is held at a time."""
    schema = pa.schema([*list(_PART)[:6], *([pa.field(a, pa.float64()) for a in _ANSWERS] if final else [_PART.field("sketch")])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: tuple | None = None

        def close():
            k, s = held
            rows.append((*k, s.n, *(_answers(s) if final else [s.dump()])))

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return out

        for b in batches:
            for *k, data in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(b.num_columns - 1)):
                s = QuantileSketch.load(data.as_py())
                if held is not None and held[0] == k:
                    held[1].merge(s)
                else:
                    if held is not None:
                        close()
                    held = k, s
            if len(rows) > 2000:
                yield batch()
        if held is not None:
            close()
        if rows:
            yield batch()

    return run


def _merged(part: DataFrame, n: int, final: bool) -> DataFrame:
    order = [*SERIES, *(c for c in ("salt",) if c in part.columns)]
    rows = part.repartition(n, *order).sortWithinPartitions(*order, "n", "sketch").select(*SERIES, "n", "sketch")
    return rows.mapInArrow(_merge(final), _DDL if final else _PART_DDL)


#: Sketches of one series that a single task merges; a session with more partitions merges in two levels.
MERGED_AT_ONCE = 512


def _slices(modality: DataFrame, kind: str, field: str) -> DataFrame:
    m = modality.where((F.col("modality") == kind) & F.col("start").isNotNull() & F.col("end").isNotNull() & (F.coalesce("original_key", F.lit(field)) == field))
    return m.groupBy("dataset_id", "key").agg(F.min(F.struct("start", "end")).alias(kind))


def relative_series(stats: DataFrame, modality: DataFrame) -> DataFrame:
    """(dataset_id, rel): the relative series asked for by `stats`, in the form `_relative` reads."""
    asked = (
        stats.where("modality = 'relative_stats' and step >= 0")
        .groupBy("dataset_id", "key")
        .agg(F.array_join(F.sort_array(F.collect_set("step")), ",").alias("steps"))
        .join(_slices(modality, "action", "action"), ["dataset_id", "key"])
        .join(_slices(modality, "state", "observation.state"), ["dataset_id", "key"])
    )
    width = F.least(F.col("action.end") - F.col("action.start"), F.col("state.end") - F.col("state.start"))
    return asked.groupBy("dataset_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "key", "action.start", "state.start", width, "steps"))), "|").alias("rel"))


def _pieces(frames: DataFrame, stats: DataFrame, modality: DataFrame, block: int) -> DataFrame:
    return frame_pieces(frames, [F.col(f"`{f}`") for f, _ in FIELDS], [n for _, n in FIELDS], block=block, after=_horizon(stats), more=relative_series(stats, modality))


def _horizon(stats: DataFrame) -> int:
    return (stats.agg(F.max("step")).first()[0] or 0) + 1


def percentiles(frames: DataFrame, stats: DataFrame, modality: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """q01 and q99 of every dimension of state and action, and of every relative series in `stats`.

    Over the distinct frame records; nulls, NaN and infinities are left out; a relative series at
    step h takes action at frame + h minus state at frame of one episode. Result: SERIES (step -1
    for plain series), n, and per percentile the estimate and the bounds the exact value lies within.
    Every value goes into a sketch of its task and series, sketches of a series merge: at once up to
    MERGED_AT_ONCE of them, beyond that in two levels. Empty frames give no rows.
    """
    pieces = _pieces(frames, stats, modality, sizes.block)
    part = pieces.mapInArrow(_sketch(sizes), _PART_DDL)
    n = partitions_of(frames)
    salts = -(-n // MERGED_AT_ONCE)
    if salts > 1:
        part = _merged(part.withColumn("salt", F.pmod(F.xxhash64("sketch"), F.lit(salts))), n, False)
    return _merged(part, n, True)


def _counts(bounds: dict[tuple, list[tuple[str, float, float]]], block: int):
    """Per series and bound: how many values lie below the bracket, and the values within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dataset_id", pa.string()), ("modality", pa.string()), ("key", pa.string()), ("step", pa.int32()), ("dim", pa.int32()), ("bound", pa.string()), ("below", pa.int64()), ("within", pa.list_(pa.float64()))])
        for t in groups(batches, 3):
            source, rows = t.column(0)[0].as_py(), []
            for modality, key, step, dim, x in series_of(t, block):
                for bound, least, most in bounds.get((source, modality, key, step, dim), ()):
                    rows.append((source, modality, key, step, dim, bound, int((x < least).sum()), x[(x >= least) & (x <= most)].tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


#: Published percentiles whose verdict the bounds leave open are checked exactly, this many series at a time.
OPEN_AT_ONCE = 50_000


def _exact(frames: DataFrame, stats: DataFrame, modality: DataFrame, open_: DataFrame, sizes: Sizes) -> DataFrame:
    """Exact q01 and q99 of the series of `open_` by selection within the brackets the sketches gave."""
    keyed = open_.select(*SERIES, "n", "q01_least", "q01_most", "q99_least", "q99_most").distinct()
    shares, out = 1, None
    while not at_most(keyed.where(F.pmod(F.xxhash64(*SERIES), F.lit(shares)) == 0), OPEN_AT_ONCE):
        shares *= 2
    for share in range(shares):
        some = keyed.where(F.pmod(F.xxhash64(*SERIES), F.lit(shares)) == share)
        bounds: dict[tuple, list] = {}
        for r in some.collect():  # at most OPEN_AT_ONCE, give or take the hash
            bounds[tuple(r[c] for c in SERIES)] = [("q01", r["q01_least"], r["q01_most"]), ("q99", r["q99_least"], r["q99_most"])]
        mine = frames.join(F.broadcast(some.select("dataset_id").distinct()), "dataset_id", "left_semi")  # at most OPEN_AT_ONCE data sets
        found = _pieces(mine, stats, modality, sizes.block).mapInArrow(_counts(bounds, sizes.block), "dataset_id string, modality string, key string, step int, dim int, bound string, below long, within array<double>")
        out = found if out is None else out.unionByName(found)
    found = cut(out)
    k = [*SERIES, "bound"]
    below = found.groupBy(*k).agg(F.sum("below").alias("below"))
    runs = found.select(*k, F.explode("within").alias("v")).groupBy(*k, "v").agg(F.count("*").alias("m"))
    runs = runs.withColumn("upto", F.sum("m").over(Window.partitionBy(*k).orderBy("v")))
    at = (F.col("n") - 1) * F.when(F.col("bound") == "q01", 0.01).otherwise(0.99)
    ranked = runs.join(below, k).join(keyed.select(*SERIES, "n"), SERIES).withColumn("upto", F.col("upto") + F.col("below")).withColumn("low", F.floor(at)).withColumn("frac", at - F.floor(at))
    value = lambda r: F.min(F.when(F.col("upto") >= r, F.col("v")))
    got = ranked.groupBy(*k).agg(value(F.col("low") + 1).alias("a"), value(F.least(F.col("low") + 2, F.col("n"))).alias("b"), F.first("frac").alias("f"))
    got = got.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))
    return got.groupBy(*SERIES).agg(F.max(F.when(F.col("bound") == "q01", F.col("x"))).alias("x01"), F.max(F.when(F.col("bound") == "q99", F.col("x"))).alias("x99"))


def wrong_percentiles(frames: DataFrame, stats: DataFrame, modality: DataFrame, tolerance: float = 0.05, sizes: Sizes = Sizes()) -> DataFrame:
    """Published q01 and q99 that differ from the actual ones by more than `tolerance` of q99 - q01.

    Result: (dataset_id, modality, key, step, dim, bound). The sketches' bounds decide nearly all;
    what they leave open is checked exactly. Null percentiles and ranges of 0 are never cases.
    """
    asked = (
        stats.where("(modality = 'stats' and key in ('observation.state', 'action')) or (modality = 'relative_stats' and step is not null)")
        .select("dataset_id", "modality", "key", F.coalesce(F.col("step"), F.lit(-1)).cast("int").alias("step"), "dim", F.explode(F.array(*[F.struct(F.lit(b).alias("bound"), F.col(b).alias("published")) for b in ("q01", "q99")])).alias("p"))
        .select(*SERIES, "p.*")
        .where("published is not null")
        .distinct()
    )
    is01 = F.col("bound") == "q01"
    pick = lambda x: F.when(is01, F.col(f"q01{x}")).otherwise(F.col(f"q99{x}"))
    p, least, most = F.col("published"), pick("_least"), pick("_most")
    near = F.when((p >= least) & (p <= most), 0.0).otherwise(F.least(F.abs(p - least), F.abs(p - most)))
    far = F.greatest(F.abs(p - least), F.abs(p - most))
    wide, narrow = F.col("q99_most") - F.col("q01_least"), F.greatest(F.lit(0.0), F.col("q99_least") - F.col("q01_most"))
    verdict = F.when((near > tolerance * wide) & (narrow > 0), "wrong").when((far <= tolerance * narrow) | (wide == 0) | p.isNull(), "right").otherwise("open")
    judged = cut(asked.join(percentiles(frames, stats, modality, sizes), SERIES).withColumn("verdict", F.when(F.isnan(p), "wrong").otherwise(verdict)))
    out = judged.where("verdict = 'wrong'").select(*SERIES, "bound")
    open_ = judged.where("verdict = 'open'")
    if open_.isEmpty():
        return out
    exact = _exact(frames, stats, modality, open_, sizes)
    gap = F.abs(p - F.when(is01, F.col("x01")).otherwise(F.col("x99")))
    return out.unionByName(open_.join(exact, SERIES).where((F.col("x99") > F.col("x01")) & (gap > tolerance * (F.col("x99") - F.col("x01")))).select(*SERIES, "bound"))
