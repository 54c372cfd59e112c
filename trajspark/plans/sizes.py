"""Broadcasts behind a check of size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side made of a few short columns may be broadcast (some 20 MB).
BROADCAST_ROWS = 200_000


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows; reads no further than needed to know."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it is proven to have at most `rows` rows, else as it is.

    Without the hint Spark joins by shuffle, and adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if at_most(df, rows) else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """`df` for joins that stay shuffle joins whatever size Spark estimates; a broadcast hint on the other side goes first.

    Estimates come from the compressed files and leave exploded rows out of account: millions of steps
    out of a small table of episodes would else be broadcast. Adaptive execution still splits skewed keys.
    """
    return df.hint("merge")


#: Stored bytes a task of a shuffle should take in.
BYTES_A_TASK = 24 << 20


def partitions_for(df: DataFrame, bytes_each: int = BYTES_A_TASK) -> int:
    """Shuffle partitions for `df` by the size its plan estimates from the files read, at least the session's number.

    A plan whose size isn't known (not read from files) gets the session's number.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-size // bytes_each)) if size < 1 << 60 else least


def spread(df: DataFrame) -> DataFrame:
    """`df` for costly work per row: dealt evenly to all cores if it is read in fewer pieces than there are.

    Only what lies in few small files is shuffled so; a scan of many pieces stays as it is.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
