"""Statistics of very many columns: moments and exact order statistics, without exploding vectors.

The rows are stored once and read twice. The first pass reduces, per task and series, the values to
their count, mean, sum of squared deviations and extremes, and to counts of *bins*: the first 18
bits of a double in sortable form (sign, exponent, 6 bits of the mantissa), so a bin is at most
1/64 of its values wide. Counts add up in any order, so the ranks at which each bin begins and ends
are exact, and with them every percentile is bounded by the edges of its bin. The second pass counts, by
value, what lies in the bins that hold the ranks asked for; there a percentile is selected exactly.

A task holds at most `HELD` counts before it hands them on; what a series needs in one place are
its bins, and the distinct values of at most two bins a percentile.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.plans.pieces import matrix
from trajspark.plans.shared import cut

#: Bits of a double below those that name its bin.
BELOW = 46
#: Counts of bins or values a task holds before it hands them on.
HELD = 2_000_000
#: Bins looked into at a time in the second pass.
BINS_AT_ONCE = 400_000

Series = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[tuple, np.ndarray]]]


def sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ (bits >> 63 & np.int64(0x7FFFFFFFFFFFFFFF))


def value_of(key: np.ndarray) -> np.ndarray:
    """The inverse of sortable."""
    key = np.asarray(key, np.int64)
    return (key ^ (key >> 63 & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


class _Held:
    """Counts by series, summed up as they come."""

    def __init__(self):
        self.of: dict[tuple, list] = {}
        self.size = 0

    def add(self, label: tuple, keys: np.ndarray, moments: tuple | None = None) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.size += len(found)
        held = self.of.setdefault(label, [None, []])
        held[1].append((found, n))
        if moments is not None:
            held[0] = moments if held[0] is None else _joined(held[0], moments)
        if len(held[1]) > 64:
            before = sum(len(k) for k, _ in held[1])
            held[1] = [_summed(held[1])]
            self.size += len(held[1][0][0]) - before

    def items(self):
        for label, (moments, parts) in self.of.items():
            yield label, moments, *_summed(parts)


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _joined(a: tuple, b: tuple) -> tuple:
    """Count, mean, squared deviations and extremes of two parts together."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n, min(a[3], b[3]), max(a[4], b[4])


def _moments(x: np.ndarray) -> tuple:
    mean = float(x.mean())
    return len(x), mean, float(((x - mean) ** 2).sum()), float(x.min()), float(x.max())


def _first(series: Series, labels: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def batch():
            rows = [(*label, *m, keys, n) for label, m, keys, n in held.items()]
            held.__init__()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for label, x in series(batches):
            held.add(label, sortable(x) >> BELOW, _moments(x))
            if held.size > HELD:
                yield batch()
        if held.of:
            yield batch()

    return run


def _second(series: Series, wanted: dict[tuple, np.ndarray], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def batch():
            rows = [(*label, *r) for label, _, keys, counts in held.items() for r in zip((keys >> BELOW).tolist(), value_of(keys).tolist(), counts.tolist())]
            held.__init__()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for label, x in series(batches):
            if (bins := wanted.get(label)) is not None:
                keys = sortable(x)
                keys = keys[np.isin(keys >> BELOW, bins)]
                if len(keys):
                    held.add(label, keys)
            if held.size > HELD:
                yield batch()
        if held.of:
            yield batch()

    return run


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}


def statistics(stored: DataFrame, labels: dict[str, str], series: Series, percentiles: dict[str, float], exact: bool = True) -> DataFrame:
    """Per series: n, mean, std (of the population), min, max, and each of `percentiles` ({column: share}).

    `stored` is a stored table, read twice if `exact`. `series` turns its batches into (label, finite
    values), a label being a tuple of `labels` (name: string, int or bigint); a series may come in any
    number of parts. Percentiles are linearly interpolated between neighbouring ranks; unless `exact`,
    they are the middles of their bins, with the edges as column_least and column_most. A series
    without values does not appear.
    """
    names = list(labels)
    head = [pa.field(k, _ARROW[t]) for k, t in labels.items()]
    ddl = ", ".join(f"`{k}` {t}" for k, t in labels.items())
    schema = pa.schema([*head, ("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64()), ("min", pa.float64()), ("max", pa.float64()), ("bins", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
    part = cut(stored.mapInArrow(_first(series, names, schema), f"{ddl}, n long, mean double, m2 double, min double, max double, bins array<long>, counts array<long>"))
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    total = part.groupBy(*names).agg(n.alias("n"), mean.alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"))
    spread = part.select(*names, F.col("n").alias("_n"), F.col("mean").alias("_m"), "m2").join(total.select(*names, "mean"), names).groupBy(*names).agg((F.sum("m2") + F.sum(F.col("_n") * (F.col("_m") - F.col("mean")) * (F.col("_m") - F.col("mean")))).alias("_m2"))
    total = total.join(spread, names).withColumn("std", F.sqrt(F.col("_m2") / F.col("n")))
    bins = part.select(*names, F.explode(F.arrays_zip("bins", "counts")).alias("b")).groupBy(*names, F.col("b.bins").alias("bin")).agg(F.sum("b.counts").alias("c"))
    by = Window.partitionBy(*names)
    bins = bins.withColumn("upto", F.sum("c").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(by))
    low = lambda q: F.floor((F.col("n") - 1) * F.lit(q)) + 1
    high = lambda q: F.least(low(q) + 1, F.col("n"))
    holds = lambda r: (F.col("upto") >= r) & (F.col("upto") - F.col("c") < r)
    hit = F.lit(False)
    for q in percentiles.values():
        hit = hit | holds(low(q)) | holds(high(q))
    target = cut(bins.where(hit).withColumn("before", F.col("upto") - F.col("c")))
    keep = [*names, "n", "mean", "std", "min", "max"]
    if not exact:
        edge = lambda up: F.pandas_udf(lambda k: pd.Series(value_of(((k.to_numpy() + up) << BELOW) - up)), "double")("bin")
        rows = target.withColumn("least", edge(0)).withColumn("most", edge(1))
        aggs = []
        for name, q in percentiles.items():
            a, b = F.min(F.when(holds(low(q)), F.col("least"))), F.max(F.when(holds(high(q)), F.col("most")))
            aggs += [a.alias(f"{name}_least"), b.alias(f"{name}_most")]
        got = rows.groupBy(*names).agg(*aggs)
        out = total.select(*keep).join(got, names)
        for name in percentiles:
            a, b = F.greatest(f"{name}_least", "min"), F.least(f"{name}_most", "max")
            out = out.withColumn(f"{name}_least", a).withColumn(f"{name}_most", b).withColumn(name, (F.col(f"{name}_least") + F.col(f"{name}_most")) / 2)
        return out
    shares = max(1, -(-target.count() // BINS_AT_ONCE))
    two = pa.schema([*head, ("bin", pa.int64()), ("value", pa.float64()), ("c", pa.int64())])
    found = None
    for share in range(shares):
        wanted: dict[tuple, list] = {}
        for r in target.select(*names, "bin").where(F.pmod(F.xxhash64(*names), F.lit(shares)) == share).collect():  # about BINS_AT_ONCE
            wanted.setdefault(tuple(r[k] for k in names), []).append(r["bin"])
        some = stored.mapInArrow(_second(series, {k: np.array(v, np.int64) for k, v in wanted.items()}, two), f"{ddl}, bin long, value double, c long")
        found = some if found is None else found.unionByName(some)
    values = found.groupBy(*names, "bin", "value").agg(F.sum("c").alias("c")).join(target.select(*names, "bin", "before", "n"), [*names, "bin"])
    values = values.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*names, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    aggs = []
    for name, q in percentiles.items():
        a, b = F.min(F.when(F.col("upto") >= low(q), F.col("value"))), F.min(F.when(F.col("upto") >= high(q), F.col("value")))
        at = (F.first("n") - 1) * F.lit(q)
        aggs.append((a + (b - a) * (at - F.floor(at))).alias(name))
    return total.select(*keep).join(values.groupBy(*names).agg(*aggs), names)


def _groups(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, positions) of the rows of each key, the first `keys` columns."""
    if not keys:
        yield (), np.arange(batch.num_rows)
        return
    code = np.zeros(batch.num_rows, np.int64)
    for i in range(keys):
        d = batch.column(i).dictionary_encode()
        code = code * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0, True])
    for a, b in zip(cuts, cuts[1:]):
        at = order[a:b]
        yield tuple(batch.column(i)[int(at[0])].as_py() for i in range(keys)), at


def _finite(x: np.ndarray) -> np.ndarray:
    return x[np.isfinite(x)]


def vectors(keys: int, names: list[str]) -> Series:
    """Series (keys, feature, dim) of vector columns, which follow the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
        for b in batches:
            if not b.num_rows:
                continue
            wide = [matrix(b.column(keys + i))[0] for i in range(len(names))]
            for key, at in _groups(b, keys):
                for name, m in zip(names, wide):
                    for d in range(m.shape[1]):
                        if len(x := _finite(m[at, d])):
                            yield (*key, name, d), x

    return run


def chunks(keys: int, relative: bool = False) -> Series:
    """Series (keys, step, dim) of a column of chunks (arrays of vectors), which follows the keys.

    With `relative` a column of vectors follows, and each vector of a chunk is taken less that of its
    row, over the dimensions both have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(keys)
            inner = column.flatten()
            m = matrix(inner)[0]
            n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            if relative:
                ref = matrix(b.column(keys + 1))[0]
                wide = min(m.shape[1], ref.shape[1])
                m = m[:, :wide] - ref[row, :wide]
            for key, at in _groups(b, keys):
                flag = np.zeros(b.num_rows, bool)
                flag[at] = True
                mine = flag[row]
                for k in range(int(step[mine].max()) + 1 if mine.any() else 0):
                    part = m[mine & (step == k)]
                    for d in range(part.shape[1]):
                        if len(x := _finite(part[:, d])):
                            yield (*key, k, d), x

    return run
