"""Reading the tables of one data folder."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; columns and filters chosen later reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
