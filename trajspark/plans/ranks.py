"""Row numbers through keys that may hold any share of all rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], block: Column, order: list[str], out: str = "rank") -> DataFrame:
    """Adds `out`: 0, 1, .. through each key in the order of `block` and, within a block, of `order`.

    `block` cuts a key into bounded runs in that order. Rows are counted per block first, so that only
    the blocks of a key, never its rows, are put in order in one task. `order` must tell the rows of a
    block apart for the numbers to be determined.
    """
    rows = df.withColumn("_block", block)
    per = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1
    return rows.withColumn("_within", within).join(per, [*keys, "_block"]).withColumn(out, F.col("_within") + F.col("_before")).drop("_block", "_within", "_before")
