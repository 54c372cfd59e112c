"""Implausible readings in vector columns, by robust exponentially weighted control charts.

One pass over the frame records, cut into pieces (see plans.pieces), does two things. It measures
each piece's normal behaviour (quantiles of values and of steps), and it runs one chart per
episode and dimension: the chart's level follows the readings with clipped updates, so suspected
values hardly move it, and its scale is an exponentially weighted mean of clipped residuals.
Readings outside the chart's limits, runs of equal readings (by start and end), readings outside wide physical limits
and readings that are not finite become candidates. The pieces' measurements are then combined
into one profile per source and dimension (weighted medians, so a bad piece cannot spoil it) and
each candidate is judged by that profile.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.plans.pieces import distinct_rows, frame_pieces, groups, matrix
from trajspark.plans.shared import cut
from trajspark.plans.sizes import small_side


@dataclass(frozen=True)
class SpikeRules:
    """Parameters of the charts and of the final judgement.

    jump: least departure from the readings before and after, in steps at the 99 % quantile.
    most_frames: longest excursion. stuck: shortest run of equal readings that is a case.
    changing: largest share of equal neighbours of a dimension that "changes at nearly every frame".
    beyond: how far outside the 1 % to 99 % range, in widths of it, a reading is out of limits.
    level, spread: weights of the newest reading in the chart's mean and scale.
    limits: chart limits in scales.
    habit: share of a dimension's steps in long runs, over the whole source, from which they are its habit.
    """

    jump: float = 4.0
    most_frames: int = 6
    stuck: int = 10
    changing: float = 0.1
    beyond: float = 0.5
    level: float = 0.85
    spread: float = 0.05
    limits: float = 5.0
    habit: float = 0.3


OUT = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # profile, nonfinite, impossible, outside, excursion, stuck
        T.StructField("dataset_id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("episode_index", T.LongType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("departure", T.DoubleType()),
        T.StructField("frames", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()),
        T.StructField("inner_lo", T.DoubleType()),
        T.StructField("inner_hi", T.DoubleType()),
        T.StructField("step", T.DoubleType()),
        T.StructField("equal", T.DoubleType()),
        T.StructField("last", T.LongType()),
        T.StructField("n_steps", T.LongType()),
        T.StructField("n_equal", T.LongType()),
        T.StructField("n_stuck", T.LongType()),
    ]
)


def _chart(grid: np.ndarray, scale: np.ndarray, r: SpikeRules) -> np.ndarray:
    """Suspects of a block (episodes, time, dims): one clipped chart per episode and dimension.

    A run of suspects longer than an excursion may be is a change of level: the chart restarts
    there. NaN readings are passed over. `scale` (dims) is where every chart's scale begins.
    """
    ep, time, dims = grid.shape
    out = np.zeros(grid.shape, bool)
    mean = np.full((ep, dims), np.nan)
    dev = np.broadcast_to(scale, (ep, dims)).copy()
    floor, top = scale * 0.6, scale * 1.2  # never so wide that a case of the final judgement could hide
    run = np.zeros((ep, dims), np.int32)
    for t in range(time):
        x = grid[:, t]
        seen = x == x
        fresh = seen & (mean != mean)
        res = np.where(seen, x - mean, 0.0)
        res[fresh] = 0.0
        far = np.abs(res) > r.limits * dev
        run = np.where(far, run + 1, np.where(seen, 0, run))
        shift = run > r.most_frames
        far &= ~shift
        run[shift] = 0
        out[:, t] = far
        limit = r.limits * dev
        clipped = np.clip(res, -limit, limit)
        move = np.where(far, 0.0, r.level) * np.where(shift, 0.0, clipped)
        mean = np.where(fresh | shift, x, mean + move)
        dev = np.clip(np.where(seen & ~far & ~shift, (1 - r.spread) * dev + r.spread * np.abs(clipped) * 1.5, dev), floor, top)
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (half-open) of the runs of True."""
    d = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _quantiles(x: np.ndarray, q: list[float]) -> list[float]:
    return [float(v) for v in np.quantile(x, q)] if len(x) else [float("nan")] * len(q)


def _piece(values: np.ndarray, there: np.ndarray, ep: np.ndarray, fr: np.ndarray, own: np.ndarray, r: SpikeRules, add, physical: tuple[float, float] | None = None) -> None:
    """Works through one piece of one field; `add` takes the output rows."""
    n, dims = values.shape
    if not n or not dims:
        return
    finite = np.isfinite(values)
    starts = np.flatnonzero(np.r_[True, ep[1:] != ep[:-1]])
    ends = np.r_[starts[1:], n]
    next_to = np.r_[False, (ep[1:] == ep[:-1]) & (fr[1:] == fr[:-1] + 1)]
    widths = np.where(there, (values == values).sum(1), 0)
    scale = np.zeros(dims)
    inner = np.zeros((dims, 2))
    with np.errstate(all="ignore"):
        step = np.abs(np.diff(values, axis=0, prepend=np.nan))
    step[~next_to] = np.nan
    runs_of = {}
    for k in range(dims):
        v = values[finite[:, k], k]
        s = step[:, k]
        s = s[np.isfinite(s)]
        if not len(v):
            continue
        lo, hi, a, b = _quantiles(v, [0.01, 0.99, 0.05, 0.95])
        moved = s[s > 0]
        scale[k] = np.median(moved) if len(moved) else 0.0
        usual = s[s <= 8 * scale[k]]  # leaps are no part of the normal steps, however many there are
        p99 = _quantiles(usual, [0.99])[0] if len(usual) else 0.0
        inner[k] = a, b
        equal = np.zeros(n, bool)
        equal[1:] = next_to[1:] & (values[1:, k] == values[:-1, k])
        i, j = _runs(equal)
        long = (j - i + 1) >= r.stuck
        # long runs are left out of the share of equal neighbours; whether they are the dimension's
        # habit is for the whole source to say, so all of them go on
        stuck = int((j[long] - i[long]).sum())
        share = (len(s) - len(moved) - stuck) / (len(s) - stuck) if len(s) > stuck else None
        runs_of[k] = (i[long], j[long])
        add("profile", k, n=len(v), lo=lo, hi=hi, inner_lo=a, inner_hi=b, step=p99, equal=share, n_steps=len(s), n_equal=len(s) - len(moved), n_stuck=stuck)
    wide = finite.any(0)
    # not finite: the vector is there and long enough to hold the dimension
    expected = int(np.bincount(widths[there].astype(int)).argmax()) if there.any() else 0
    hit = there[:, None] & ~finite & own[:, None]
    hit[:, np.arange(dims) >= max(expected, 0)] &= ~np.isnan(values[:, np.arange(dims) >= max(expected, 0)])
    for i, k in zip(*np.nonzero(hit)):
        add("nonfinite", int(k), i, value=float("nan"))
    # outside limits and the chart
    moving = np.flatnonzero(wide & (scale > 0))
    for k in np.flatnonzero(wide):
        a, b = inner[k]
        v = np.where(finite[:, k], values[:, k], a)
        room = 0.35 * (b - a)
        far = (v < a - room) | (v > b + room)
        if physical is not None:
            for i in np.flatnonzero(own & finite[:, k] & ((values[:, k] < physical[0]) | (values[:, k] > physical[1]))):
                add("impossible", int(k), i, value=float(values[i, k]))
        for i in np.flatnonzero(far & own):
            add("outside", int(k), i, value=float(values[i, k]))
    # chart: episodes of similar length together, to waste little on padding
    if len(moving):
        length = ends - starts
        order = np.argsort(length, kind="stable")
        suspects = np.zeros((n, len(moving)), bool)
        clean = np.where(finite, values, np.nan)[:, moving]
        for c in range(0, len(order), 16):
            some = order[c : c + 16]
            long = int(length[some].max())
            grid = np.full((len(some), long, len(moving)), np.nan)
            for g, e in enumerate(some):
                grid[g, : length[e]] = clean[starts[e] : ends[e]]
            marks = _chart(grid, scale[moving], r)
            for g, e in enumerate(some):
                suspects[starts[e] : ends[e]] |= marks[g, : length[e]]
        for m, k in enumerate(moving):
            if not suspects[:, m].any():
                continue
            good = np.flatnonzero(finite[:, k])  # the chart passed over the rest
            v, e = values[good, k], ep[good]
            i, j = _runs(suspects[good, m])
            for a, b in zip(i.tolist(), j.tolist()):
                _excursion(v, e, good, a, b, int(k), own, scale[k], r, add)
    for k, (i, j) in runs_of.items():
        for a, b in zip(i.tolist(), j.tolist()):
            mine = np.flatnonzero(own[a:b])  # without a gap, as a run's frames follow each other
            if len(mine):
                add("stuck", int(k), a + int(mine[0]), last=int(fr[a + mine[-1]]), frames=b - a + 1)


def _excursion(v, e, good, a, b, k, own, scale, r, add) -> None:
    """Finds the excursions in and beside a run [a, b) of suspects, measured against the readings around them.

    The chart's level stands still while it suspects, so a run may go on past the excursion that began
    it, or hold several. The stretch of readings that departs most from those before and after it is
    taken out, then the next, until none departs by more than the charts' limit.
    """
    lo, hi = max(0, a - 3), min(len(v), b + 4)
    at = [i for i in range(lo, hi) if e[i] == e[a]]
    while len(at) > 2:
        w = v[at]
        best = (r.limits * scale * 0.6, 0, 0)
        for x in range(1, len(at) - 1):
            for y in range(x + 1, min(x + r.most_frames, len(at) - 1) + 1):
                d = float(np.minimum(np.abs(w[x:y] - w[x - 1]), np.abs(w[x:y] - w[y])).min())
                if d > best[0]:
                    best = (d, x, y)
        d, x, y = best
        if not y:
            return
        for i in at[x:y]:
            if own[good[i]]:
                add("excursion", k, int(good[i]), value=float(v[i]), departure=d, frames=y - x)
        del at[x:y]


def _scan(fields: list[str], r: SpikeRules, before: int, physical: dict[str, tuple[float, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in OUT.fields]
        rows: dict[str, list] = {c: [] for c in names}
        schema = pa.schema([("kind", pa.string()), ("dataset_id", pa.string()), ("field", pa.string()), ("dim", pa.int32()), ("episode_index", pa.int64()), ("frame_index", pa.int64()), ("value", pa.float64()), ("departure", pa.float64()), ("frames", pa.int32()), ("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("inner_lo", pa.float64()), ("inner_hi", pa.float64()), ("step", pa.float64()), ("equal", pa.float64()), ("last", pa.int64()), ("n_steps", pa.int64()), ("n_equal", pa.int64()), ("n_stuck", pa.int64())])
        for t in groups(batches, 3):
            keep = distinct_rows(t)
            t = t.take(pa.array(keep))
            source, block = t.column(0)[0].as_py(), t.column(2)[0].as_py()
            ep, fr = t.column("episode_index").to_numpy(), t.column("frame_index").to_numpy()
            own = fr // before == block
            for name in fields:
                values, there = matrix(t.column(name))

                def add(kind, dim, at=None, name=name, **x):
                    row = {"kind": kind, "dataset_id": source, "field": name, "dim": dim} | x
                    if at is not None:
                        row |= {"episode_index": int(ep[at]), "frame_index": int(fr[at])}
                    for c in names:
                        rows[c].append(row.get(c))

                _piece(values, there, ep, fr, own, r, add, physical.get(name))
            if len(rows["kind"]) > 20_000:
                yield pa.RecordBatch.from_pydict(rows, schema=schema)
                rows = {c: [] for c in names}
        if rows["kind"]:
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


def implausible(frames: DataFrame, fields: list[str], rules: SpikeRules = SpikeRules(), block: int = 16384, physical: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Readings that cannot be right: (dataset_id, episode_index, frame_index, field, dim, reasons).

    Each frame record counts once however often it is stored; null vectors and rows with a null key
    give nothing; NaN, infinities and nulls inside a vector are `nonfinite`. An empty table gives no rows.
    An excursion needs a reading on either side. Columns other than the keys and `fields` are ignored.
    `physical` are stated limits (least, greatest) of a field's readings; what lies beyond them is
    `impossible` whatever the source does. Without them the source's own range sets the limits.
    """
    cols = [f"v{i}" for i in range(len(fields))]
    pieces = frame_pieces(frames, [F.col(f"`{f}`") for f in fields], cols, block=block, before=64, after=64)
    found = cut(pieces.mapInArrow(_scan(cols, rules, block, {c: (physical or {})[f] for c, f in zip(cols, fields) if f in (physical or {})}), OUT))
    key = ["dataset_id", "field", "dim"]
    med = lambda c: F.percentile(c, F.lit(0.5), F.col("n")).alias(c)
    profile = (
        found.where("kind = 'profile' and n > 0 and lo is not null and not isnan(lo)")
        .groupBy(*key)
        .agg(*[med(c) for c in ("lo", "hi", "inner_lo", "inner_hi", "step", "equal")], *[F.sum(c).alias(c) for c in ("n_steps", "n_equal", "n_stuck")])
        .withColumn("equal", F.when(F.col("n_stuck") >= rules.habit * F.col("n_steps"), F.col("n_equal") / F.greatest(F.lit(1), "n_steps")).otherwise(F.col("equal")))
        .drop("n_steps", "n_equal", "n_stuck")
    )
    hits = found.where("kind <> 'profile'").select(*key, "kind", "episode_index", "frame_index", "value", "departure", "frames", "last")
    r, wide = rules, F.col("hi") - F.col("lo")
    outside = (F.col("value") < F.col("lo") - r.beyond * wide) | (F.col("value") > F.col("hi") + r.beyond * wide)
    keep = (
        F.col("kind").isin("nonfinite", "impossible")
        | ((F.col("kind") == "outside") & outside)
        | ((F.col("kind") == "excursion") & (F.col("step") > 0) & (F.col("departure") > F.greatest(F.lit(r.jump), F.col("frames").cast("double")) * F.col("step")))
        | ((F.col("kind") == "stuck") & (F.col("equal") < r.changing))
    )
    names = F.create_map(*[F.lit(x) for pair in zip(cols, fields) for x in pair])
    return (
        hits.join(small_side(profile), key, "left")
        .where(keep)
        .withColumn("frame_index", F.explode(F.sequence("frame_index", F.coalesce("last", "frame_index"))))
        .groupBy("dataset_id", "episode_index", "frame_index", "field", "dim")
        .agg(F.sort_array(F.collect_set("kind")).alias("reasons"))
        .withColumn("field", names[F.col("field")])
    )
