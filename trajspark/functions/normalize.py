"""Normalization of vectors by statistics, and its inverse, as native expressions.

Bounds are vectors beside the data (array columns); `zip` runs over values and bounds together. For
chunks (arrays of vectors) the functions on `steps` take bounds that are one vector for all steps or
a chunk of one vector a step.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajspark.functions.arrays import clip, doubles


def _zip3(v: Column, a: Column, b: Column, f) -> Column:
    pairs = F.zip_with(doubles(a), doubles(b), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.zip_with(doubles(v), pairs, lambda x, p: f(x, p["a"], p["b"]))


def minmax(v: Column, lo: Column, hi: Column) -> Column:
    """To [-1, 1]; a dimension whose bounds are close (relative to the lower) becomes 0. Not clipped."""
    close = lambda a, b: F.abs(b - a) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(a)
    return _zip3(v, lo, hi, lambda x, a, b: F.when(close(a, b), 0.0).otherwise(2 * (x - a) / (b - a) - 1))


def unminmax(v: Column, lo: Column, hi: Column) -> Column:
    """Back from [-1, 1] after clipping to it; a degenerate dimension becomes its midpoint."""
    return _zip3(v, lo, hi, lambda x, a, b: (clip(x) + 1) / 2 * (b - a) + a)


def meanstd(v: Column, mean: Column, std: Column) -> Column:
    """Z-scores; a dimension of no spread passes unchanged."""
    return _zip3(v, mean, std, lambda x, m, s: F.when(s == 0, x).otherwise((x - m) / s))


def unmeanstd(v: Column, mean: Column, std: Column) -> Column:
    return _zip3(v, mean, std, lambda x, m, s: F.when(s == 0, x).otherwise(x * s + m))


def steps(chunk: Column, f, *bounds: Column, per_step: bool = False) -> Column:
    """f(vector, *bounds) at every step of a chunk; with `per_step` each bound is a chunk too, taken step by step.

    A step beyond the bounds' last has null bounds and gives null values.
    """
    if not per_step:
        return F.transform(chunk, lambda v: f(v, *bounds))
    return F.transform(chunk, lambda v, i: f(v, *[F.get(b, i) for b in bounds]))


def clipped(v: Column) -> Column:
    return F.transform(doubles(v), lambda x: clip(x))


def state(v: Column, mode: str, stats: dict[str, Column]) -> Column:
    """A state group by its mode: sincos, meanstd (not clipped) or minmax (clipped)."""
    if mode == "sincos":
        from trajspark.functions.arrays import sin_cos

        return sin_cos(v)
    if mode == "meanstd":
        return meanstd(v, stats["mean"], stats["std"])
    if mode == "minmax":
        return clipped(minmax(v, stats["min"], stats["max"]))
    raise ValueError(f"unknown mode {mode}")


def unstate(v: Column, mode: str, stats: dict[str, Column]) -> Column:
    if mode == "sincos":
        raise ValueError("sine and cosine encoding can't be undone")
    return unmeanstd(v, stats["mean"], stats["std"]) if mode == "meanstd" else unminmax(v, stats["min"], stats["max"])


def action(v: Column, mode: str, stats: dict[str, Column], reference: Column | None = None) -> Column:
    """An action vector: relative to `reference` if there is one, normalized, always clipped."""
    from trajspark.functions.arrays import minus

    v = minus(v, reference) if reference is not None else v
    return clipped(meanstd(v, stats["mean"], stats["std"]) if mode == "meanstd" else minmax(v, stats["min"], stats["max"]))


def unaction(v: Column, mode: str, stats: dict[str, Column], reference: Column | None = None) -> Column:
    from trajspark.functions.arrays import plus

    v = unmeanstd(v, stats["mean"], stats["std"]) if mode == "meanstd" else unminmax(v, stats["min"], stats["max"])
    return plus(v, reference) if reference is not None else v


def parameters(stats: dict, keys: list[str], relative: dict | None = None, percentiles: bool = False) -> dict:
    """Which bounds each key uses, decided at plan time.

    With `percentiles`, q01 and q99 stand in for min and max; a key with relative statistics takes
    those as they are, with their own min and max. A key without statistics is a KeyError.
    """
    out = {}
    for k in keys:
        if relative and k in relative:
            out[k] = dict(relative[k])
            continue
        s = dict(stats[k])
        if percentiles:
            s["min"], s["max"] = s["q01"], s["q99"]
        out[k] = s
    return out


def install(current: dict, new: dict, override: bool = False) -> tuple[dict, list[str]]:
    """(statistics after installing `new`, names discarded): the first to come stays unless overridden."""
    if override:
        return current | new, []
    return new | current, sorted(k for k in new if k in current)
