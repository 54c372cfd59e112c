"""Checks of a DataFrame's shape: at plan time what the schema tells, per row what only the data tell."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ("float", "double")


@dataclass(frozen=True)
class Spec:
    """What a column must be: `kind` vector, chunk (array of vectors), image or text; sizes where fixed.

    Images are structs of h, w, c and binary data, or arrays of them over time for a given horizon.
    """

    kind: str
    horizon: int | None = None
    width: int | None = None
    channels: int | None = None


def _fits(kind: T.DataType, spec: Spec) -> bool:
    number = lambda t: t.typeName() in NUMBERS
    array = lambda t: isinstance(t, T.ArrayType)
    image = lambda t: isinstance(t, T.StructType) and {"h", "w", "c", "data"} <= set(t.names)
    if spec.kind == "text":
        return isinstance(kind, T.StringType)
    if spec.kind == "vector":
        return array(kind) and number(kind.elementType)
    if spec.kind == "chunk":
        return array(kind) and array(kind.elementType) and number(kind.elementType.elementType)
    if spec.kind == "image":
        return image(kind) if spec.horizon is None else array(kind) and image(kind.elementType)
    raise ValueError(f"unknown kind {spec.kind}")


def faults(df: DataFrame, specs: dict[str, Spec]) -> list[str]:
    """What is wrong with the schema: missing columns and wrong types."""
    out = []
    for name, spec in specs.items():
        if name not in df.columns:
            out.append(f"{name} is missing")
        elif not _fits(df.schema[name].dataType, spec):
            out.append(f"{name} is {df.schema[name].dataType.simpleString()}, not a {spec.kind}")
    return out


def _wide(n: int):
    return lambda v: F.size(v) == n


def _deep(n: int):
    return lambda v: v["c"] == n


def conditions(specs: dict[str, Spec]) -> dict[str, Column]:
    """Per fault the condition that holds for a good row: presence, horizon, width, channels."""
    out = {}
    for name, s in specs.items():
        c = F.col(f"`{name}`")
        out[f"{name} is null"] = c.isNotNull()
        if s.horizon is not None:
            out[f"{name} has not {s.horizon} steps"] = F.size(c) == s.horizon
        if s.width is not None:
            out[f"{name} is not {s.width} wide"] = F.forall(c, _wide(s.width)) if s.kind == "chunk" else _wide(s.width)(c)
        if s.channels is not None:
            out[f"{name} has not {s.channels} channels"] = _deep(s.channels)(c) if s.horizon is None else F.forall(c, _deep(s.channels))
    return out


def checked(df: DataFrame, specs: dict[str, Spec]) -> DataFrame:
    """`df`, failing at once for a wrong schema and, when it is run, at the first row that doesn't fit."""
    if bad := faults(df, specs):
        raise TypeError("; ".join(bad))
    good = F.lit(True)
    for text, ok in reversed(conditions(specs).items()):
        good = F.when(F.coalesce(ok, F.lit(False)), good).otherwise(F.raise_error(F.lit(text)).cast("boolean"))
    return df.where(good)  # a filter, so that no later choice of columns prunes the checks away


def violations(df: DataFrame, specs: dict[str, Spec]) -> DataFrame:
    """The rows that don't fit, with `faults`, the list of what is wrong."""
    if bad := faults(df, specs):
        raise TypeError("; ".join(bad))
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(t)) for t, ok in conditions(specs).items()]))
    return df.withColumn("faults", wrong).where(F.size("faults") > 0)


def strict(step: Callable[[DataFrame], DataFrame], before: dict[str, Spec], after: dict[str, Spec]) -> Callable[[DataFrame], DataFrame]:
    """A step between checks of what goes in and what comes out, for DataFrame.transform."""
    return lambda df: checked(step(checked(df, before)), after)


def with_time_axis(schema: T.StructType, horizons: dict[str, int]) -> T.StructType:
    """The schema with the named fields repeated over time; the number of steps is kept in the field's metadata."""
    if bad := [k for k, h in horizons.items() if h < 1 or k not in schema.names]:
        raise ValueError(f"no steps or no field: {', '.join(bad)}")
    return T.StructType([T.StructField(f.name, T.ArrayType(f.dataType), f.nullable, {**f.metadata, "horizon": horizons[f.name]}) if f.name in horizons else f for f in schema.fields])


def repeated(df: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """The named columns as arrays of so many equal steps, the time axis first."""
    schema = with_time_axis(df.schema, horizons)
    return df.select(*[F.array_repeat(f"`{f.name}`", horizons[f.name]).alias(f.name, metadata=f.metadata) if f.name in horizons else F.col(f"`{f.name}`") for f in schema.fields])
