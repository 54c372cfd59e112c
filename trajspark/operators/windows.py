"""Windows over the ordered rows of a sequence: offsets, chunks, replay, interpolation, resampling.

`keys` name a sequence and `order` its position. All columns over one ordering share one Window node.
"""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trajspark.functions.arrays import minus


def offsets(df: DataFrame, keys: list[str], order: str, value: str, deltas: list[int], boundary: str = "clamp", out: str = "chunk") -> DataFrame:
    """Adds `out`: the values at each offset of `deltas`, in that order.

    boundary: `drop` leaves out rows with an offset beyond the ends, `clamp` takes the end rows,
    `wrap` takes negative positions from the end (and drops rows beyond it), `error` fails on any
    offset beyond the ends. Rows must be numbered 0, 1, .. within a sequence for `wrap`.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cell = F.struct(F.col(value).alias("v"))
    at = lambda d: F.lag(cell, -d).over(w) if d < 0 else F.lead(cell, d).over(w)
    if boundary == "clamp":
        first, last = F.first(cell).over(whole), F.last(cell).over(whole)
        cells = [F.coalesce(at(d), first if d < 0 else last) for d in deltas]
    elif boundary == "wrap":
        # position i in -n..-1 counts from the end: one array of the sequence's last rows serves all
        back = max([0, *[-d for d in deltas]])
        df = df.withColumn("_n", F.count("*").over(whole)).withColumn("_i", F.row_number().over(w) - 1)
        tail = F.filter(F.collect_list(F.when(F.col("_i") >= F.col("_n") - back, F.struct(F.col("_i").alias("i"), cell.alias("c")))).over(whole), lambda x: x.isNotNull())
        df = df.withColumn("_tail", tail)

        def wrapped(d: int) -> Column:
            p = F.col("_i") + d + F.col("_n")
            return F.coalesce(at(d), F.element_at(F.filter("_tail", lambda x: x["i"] == p), 1)["c"]) if d < 0 else at(d)

        df = df.withColumn("_c", F.array(*[F.coalesce(wrapped(d), F.lit(None)) for d in deltas]))
        df = df.where(F.forall("_c", lambda x: x.isNotNull()))
        return df.withColumn(out, F.transform("_c", lambda x: x["v"])).drop("_n", "_i", "_tail", "_c")
    else:
        cells = [at(d) for d in deltas]
    df = df.withColumn("_c", F.array(*cells))
    if boundary == "drop":
        df = df.where(F.forall("_c", lambda x: x.isNotNull()))
    elif boundary == "error":
        df = df.withColumn("_c", F.when(F.exists("_c", lambda x: x.isNull()), F.raise_error(F.lit("an offset lies beyond the sequence")).cast(df.schema["_c"].dataType)).otherwise(F.col("_c")))
    elif boundary != "clamp":
        raise ValueError(f"unknown boundary {boundary}")
    return df.withColumn(out, F.transform("_c", lambda x: x["v"])).drop("_c")


def chunk(w: WindowSpec, value: Column, horizon: int) -> Column:
    """The next `horizon` values from the current row on, fewer at the end; nulls keep their place."""
    rows = F.collect_list(F.struct(value.alias("v"))).over(w.rowsBetween(Window.currentRow, horizon - 1))
    return F.transform(rows, lambda x: x["v"])


def usable(length: Column, deltas: list[int]) -> Column:
    """Number of steps with a full window: length less the span of the offsets, at least 0."""
    return F.greatest(F.lit(0), length - (max(deltas) - min(deltas) + 1) + 1)


def replay(df: DataFrame, keys: list[str], order: str, value: str, horizon: int, stride: int = 1) -> DataFrame:
    """Chunks of `horizon` values at every `stride`-th row, padded with the sequence's last value."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = chunk(w, F.col(value), horizon)
    df = df.withColumn("_c", c).withColumn("_last", F.last(value).over(whole)).withColumn("_i", F.row_number().over(w) - 1)
    padded = F.concat("_c", F.array_repeat(F.col("_last"), F.lit(horizon) - F.size("_c")))
    return df.where(F.col("_i") % stride == 0).withColumn("chunk", padded).drop("_c", "_last", "_i")


def stitched(df: DataFrame, keys: list[str], order: str, chunk_column: str, horizon: int, steps: Column | None = None) -> DataFrame:
    """The first `horizon` values of the chunks at rows 0, horizon, 2 horizon, .. as one sequence (step, value)."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    df = df.withColumn("_i", i)
    if steps is not None:
        df = df.withColumn("_n", steps)
    anchors = df.where(F.col("_i") % horizon == 0)
    out = anchors.select(*keys, *(["_n"] if steps is not None else []), "_i", F.posexplode(F.slice(chunk_column, 1, horizon)).alias("_k", "value"))
    out = out.withColumn("step", F.col("_i") + F.col("_k"))
    if steps is not None:
        out = out.where(F.col("step") < F.col("_n")).drop("_n")
    return out.drop("_i", "_k")


def history(df: DataFrame, keys: list[str], order: str, value: str, lags: list[int], out: str = "history") -> DataFrame:
    """The values `lags` rows back, the first value where there are fewer rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.array(*[F.coalesce(F.lag(value, k).over(w), first) if k else F.col(value) for k in lags]))


def relative_chunk(c: Column, reference: Column | None = None) -> Column:
    """Each vector of a chunk less a reference, by default its first vector."""
    ref = c[0] if reference is None else reference
    return F.transform(c, lambda v: minus(v, ref))


def delta_chunk(c: Column, reference: Column | None = None) -> Column:
    """Each vector less the one before; the first less the reference, or zeros without one."""
    ref = c[0] if reference is None else reference
    return F.transform(c, lambda v, i: minus(v, F.when(i == 0, ref).otherwise(F.get(c, i - 1))))


def absolute_chunk(c: Column, reference: Column) -> Column:
    """The inverse of relative_chunk."""
    from trajspark.functions.arrays import plus

    return F.transform(c, lambda v: plus(v, reference))


def monotonic(df: DataFrame, keys: list[str], order: str, time: str) -> DataFrame:
    """Without rows whose time does not pass that of the row before, as the rows were."""
    was = F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_was", was).where(F.col("_was").isNull() | (F.col(time) > F.col("_was"))).drop("_was")


def interpolate(df: DataFrame, keys: list[str], time: str, value: str, queries: DataFrame, at: str) -> DataFrame:
    """Linear values (numbers or vectors) at the times `at` of `queries` (keys, at): (keys, at, value).

    An as-of join by union: readings and queries of a sequence in one ordering, the last reading
    before and the first after carried to each query. A query outside the readings gives null.
    """
    kind = "array<double>" if dict(df.dtypes)[value].startswith("array") else "double"
    point = F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast(kind).alias("v"))
    both = df.select(*keys, F.col(time).cast("double").alias("_t"), point.alias("_p"), F.lit(False).alias("_q")).unionByName(
        queries.select(*keys, F.col(at).cast("double").alias("_t"), F.lit(None).cast(f"struct<t:double,v:{kind}>").alias("_p"), F.lit(True).alias("_q"))
    )
    w = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    u = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumn("_a", F.last("_p", ignorenulls=True).over(w)).withColumn("_b", F.first("_p", ignorenulls=True).over(u)).where("_q")
    a, b = F.col("_a"), F.col("_b")
    between = lambda x, y: x + (y - x) * (F.col("_t") - a["t"]) / (b["t"] - a["t"])
    v = F.when(a["t"] == b["t"], a["v"]).otherwise(F.zip_with(a["v"], b["v"], between) if kind.startswith("array") else between(a["v"], b["v"]))
    return both.select(*keys, F.col("_t").alias(at), v.alias("value"))


def nearest(df: DataFrame, keys: list[str], time: str, order: str, queries: DataFrame, at: str) -> DataFrame:
    """For each query time the `order` of the reading nearest in time, the earlier on a tie: (keys, at, order).

    Several readings at one time count as their first. Union and two carried readings, as in interpolate.
    """
    point = F.struct(F.col(time).cast("double").alias("t"), F.col(order).alias("o"))
    seen = df.groupBy(*keys, F.col(time).cast("double").alias("_t")).agg(F.min(point).alias("_p"))
    both = seen.select(*keys, "_t", "_p", F.lit(False).alias("_q")).unionByName(queries.select(*keys, F.col(at).cast("double").alias("_t"), F.lit(True).alias("_q")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    u = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumn("_a", F.last("_p", ignorenulls=True).over(w)).withColumn("_b", F.first("_p", ignorenulls=True).over(u)).where("_q")
    a, b, t = F.col("_a"), F.col("_b"), F.col("_t")
    o = F.when(a.isNull(), b["o"]).when(b.isNull(), a["o"]).when(t - a["t"] <= b["t"] - t, a["o"]).otherwise(b["o"])
    return both.select(*keys, F.col("_t").alias(at), o.alias(order))


def resample(df: DataFrame, keys: list[str], time: str, order: str, start: Column, dt: float, eps: float = 1e-5, first: int | None = 0, allow_negative: bool = False) -> DataFrame:
    """Grid slots and the row each takes: (keys, slot, order).

    A row fills all slots up to its own that no earlier row filled; further rows of a slot are
    dropped. `first` is the next slot to fill, None for the first row's own.
    """
    w = Window.partitionBy(*keys).orderBy(time, order)
    g = F.floor((F.col(time).cast("double") - start) / F.lit(dt) + F.lit(eps))
    rows = df.withColumn("_g", g)
    if not allow_negative:
        rows = rows.where("_g >= 0")
    done = F.max("_g").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1
    begin = F.coalesce(F.greatest(done, F.lit(first)), F.lit(first)) if first is not None else F.coalesce(done, F.col("_g"))
    rows = rows.withColumn("_s", begin).where("_g >= _s")
    return rows.select(*keys, F.explode(F.sequence("_s", "_g")).alias("slot"), order)


def ensemble(df: DataFrame, keys: list[str], order: str, plan: str, horizon: int, most: int = 5, rate: float = 0.005, newest: list[int] | None = None, every: int = 1) -> DataFrame:
    """The blended vector of every step from the overlapping plans made at it and before: (keys, step, vector).

    Each row's `plan` (array of `horizon` vectors) was made at that step; only every `every`-th is
    used. The newest `most` plans that still cover a step are weighted exp(rate * k), k growing
    towards the newest; the dimensions `newest` come from the newest plan alone.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_i", F.row_number().over(w) - 1)
    # the vector that the plan of j rows before has for this row; only rows that plan, newest first
    cell = lambda j: F.lag(F.when(F.col("_i") % every == 0, F.struct(F.col(plan)[j].cast("array<double>").alias("v"))), j).over(w)
    votes = F.array_compact(F.array(*[cell(j) for j in range(horizon)]))
    rows = rows.withColumn("_p", F.slice(F.filter(votes, lambda x: x["v"].isNotNull()), 1, most)).where(F.size("_p") > 0)
    weights = F.transform("_p", lambda _, k: F.exp(F.lit(rate) * (F.size("_p") - 1 - k)))
    rows = rows.select(*keys, F.col("_i").cast("bigint").alias("step"), "_p", weights.alias("_w")).withColumn("_s", F.aggregate("_w", F.lit(0.0), lambda t, x: t + x))
    last = F.col("_p")[0]["v"]
    add = lambda k: F.aggregate(F.zip_with("_p", "_w", lambda x, y: x["v"][k] * y), F.lit(0.0), lambda t, x: t + x) / F.col("_s")
    mixed = F.transform(F.sequence(F.lit(0), F.size(last) - 1), lambda k: F.when(k.isin(newest), last[k]).otherwise(add(k)) if newest else add(k))
    return rows.select(*keys, "step", mixed.alias("vector"))


def receding(df: DataFrame, keys: list[str], order: str, plan: str, horizon: int, steps: int) -> DataFrame:
    """One plan is carried out for `steps` rows, then the next is asked for: (keys, step, vector)."""
    return stitched(df, keys, order, plan, min(horizon, steps), F.count("*").over(Window.partitionBy(*keys))).withColumnRenamed("value", "vector")


def sessions(df: DataFrame, keys: list[str], order: str, done: str) -> DataFrame:
    """Adds `run`: the number of rows marked `done` before this one, so that each mark closes a run."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("run", F.coalesce(F.sum(F.col(done).cast("int")).over(w), F.lit(0)))


def latched(df: DataFrame, keys: list[str], order: str, value: str, repeat: int, threshold: float = 0.5) -> DataFrame:
    """The sticky gripper: 1 - 2x is latched when its size exceeds `threshold` and then held for `repeat` rows.

    A sequential scan per sequence, over Arrow groups: (keys, order, latched).
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, held, n = [], None, 0
        for x in pdf[value].to_numpy(float):
            v = 1 - 2 * x
            if held is None and abs(v) > threshold:
                held = v
            if held is not None:
                n += 1
                v = held
            if n == repeat:
                held, n = None, 0
            out.append(v)
        return pdf[[*keys, order]].assign(latched=out)

    kinds = dict(df.dtypes)
    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*keys, order]) + ", latched double")
