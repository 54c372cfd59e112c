"""Vector columns: slicing into groups, joining, padding, comparing. All native expressions.

A vector is array<float> or array<double>; null vectors give null. Nulls within a vector stay null.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it; keeps generated code small."""
    return F.element_at(F.transform(F.array(value), f), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def group_slice(v: Column, start: int | Column, end: int | Column) -> Column:
    """Elements [start, end), zero-based; an end past the vector is cut off there."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.slice(v, start + 1, F.greatest(end - start, F.lit(0)))


def concat_groups(*groups: Column) -> Column:
    """Groups joined to one vector in the order given."""
    return F.concat(*groups)


def split_groups(v: Column, widths: list[tuple[str, int]]) -> dict[str, Column]:
    """The inverse of concat_groups: each group's slice at the running offset of the widths."""
    out, at = {}, 0
    for name, w in widths:
        out[name] = group_slice(v, at, at + w)
        at += w
    return out


def pad_right(v: Column, width: int, fill: float = 0.0) -> Column:
    """The vector with `fill` up to `width`; a longer vector is an error."""
    return F.when(F.size(v) > width, F.raise_error(F.concat(F.lit("vector of "), F.size(v).cast("string"), F.lit(f" elements, at most {width} allowed"))).cast("array<double>")).otherwise(
        F.concat(doubles(v), F.array_repeat(F.lit(float(fill)), F.lit(width) - F.size(v)))
    )


def pad_mask(v: Column, width: int) -> Column:
    """1 for each element that is there, 0 for each that pad_right adds."""
    n = F.size(v)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i < n).cast("int"))


def pad_rows(rows: Column, height: int, width: int) -> Column:
    """A chunk (array of vectors) padded to height x width with zeros."""
    return F.concat(F.transform(rows, lambda v: pad_right(v, width)), F.array_repeat(F.array_repeat(F.lit(0.0), width), F.lit(height) - F.size(rows)))


def take_last(xs: Column, n: int) -> Column:
    """The last n elements, or all if there are fewer."""
    return F.slice(xs, -F.greatest(F.lit(1), F.least(F.lit(n), F.size(xs))), F.lit(n)) if n > 0 else F.slice(xs, 1, 0)


def minus(a: Column, b: Column) -> Column:
    """Difference by element; vectors of different lengths are an error."""
    return _same(a, b, F.zip_with(doubles(a), doubles(b), lambda x, y: x - y))


def plus(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(doubles(a), doubles(b), lambda x, y: x + y))


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("array<double>")).otherwise(value)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether vectors agree within atol + rtol * |b|; false for different lengths."""
    near = F.forall(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda x: F.coalesce(x, F.lit(False)))
    return (F.size(a) == F.size(b)) & near


def clip(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    """x within [lo, hi]; NaN stays NaN, which greatest and least would turn into a bound."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def sin_cos(v: Column) -> Column:
    """All sines, then all cosines."""
    return F.concat(F.transform(doubles(v), F.sin), F.transform(doubles(v), F.cos))


def exponential_weights(n: Column, rate: float) -> Column:
    """n weights exp(rate * k), k from 0, that add up to 1."""
    raw = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.exp(F.lit(rate) * k))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raw, lambda x: x / total)


def ramp_weights(horizon: int, frozen: int, overlap: int, rate: float) -> Column:
    """How strongly each step of a new chunk may move: 0 while frozen, rising exponentially to 1 over
    the steps that overlap the previous chunk, 1 beyond."""
    if not 0 <= frozen <= overlap <= horizon:
        raise ValueError("0 <= frozen <= overlap <= horizon must hold")
    rise = lambda t: 1 - F.exp(F.lit(-rate) * t)

    def weight(i: Column) -> Column:
        t = (i - frozen + 1) / F.lit(float(overlap - frozen + 1))
        return F.when(i < frozen, 0.0).when(i >= overlap, 1.0).otherwise(rise(t) / rise(F.lit(1.0)))

    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), weight)


def masked_mean_square(a: Column, b: Column, mask: Column) -> Column:
    """Sum of masked squared differences over (number of masked elements + 1e-6)."""
    square = F.zip_with(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), doubles(mask), lambda x, m: x * m)
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return add(square) / (add(doubles(mask)) + F.lit(1e-6))


def blend(noise: Column, target: Column, t: Column) -> Column:
    """(1 - t) * noise + t * target."""
    return F.zip_with(doubles(noise), doubles(target), lambda x, y: (1 - t) * x + t * y)
