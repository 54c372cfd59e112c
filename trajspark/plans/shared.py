"""The folder all executors share, and cutting lineage there."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from trajspark.plans.files import opened


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir.

    Only where that is unset and the master is local (tests), a temporary folder is made and
    set; on a cluster an unset folder is an error, since a machine-local one would not be shared.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="trajspark-")
        sc.setCheckpointDir(at)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and read back from a Parquet table in the shared folder.

    Written rather than checkpoint()ed because Parquet is compressed, columnar and prunable; the
    files survive lost executors. They stay until the folder is cleared by the cluster.
    """
    return cut_at(df)[0]


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As `cut`, with the place of the table, for `discard`."""
    spark = df.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def discard(at: str) -> None:
    """Deletes a table that `cut_at` wrote and no plan will read any more."""
    fs, path = opened(at)
    fs.delete_dir(path)
