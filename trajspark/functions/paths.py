"""Path patterns with format fields, and path spelling, as native expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill_path(pattern: Column, numbers: dict[str, Column], texts: dict[str, Column]) -> Column:
    """`pattern` with its {name} and {name:0Nd} fields filled in; null if a used value is null.

    A field of no known name makes the result null.
    """
    pieces = F.split(pattern, r"(?=\{)|(?<=\})")

    def piece(p: Column) -> Column:
        out = F.when(~p.startswith("{"), p)
        for name, value in numbers.items():
            width = F.regexp_extract(p, r":0?(\d+)d\}$", 1)
            width = F.when(width == "", 0).otherwise(width.cast("int"))
            text = value.cast("string")
            out = out.when(p.rlike(r"^\{" + name + r"(:0?\d*d)?\}$"), F.lpad(text, F.greatest(width, F.length(text)), F.lit("0")))
        for name, value in texts.items():
            out = out.when(p == F.lit("{" + name + "}"), value)
        return out

    filled = F.transform(pieces, piece)
    return F.when(~F.exists(filled, lambda x: x.isNull()), F.array_join(filled, ""))


def plain_path(path: Column) -> Column:
    """A path without leading ./ and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), r"^(\./)+", "")
