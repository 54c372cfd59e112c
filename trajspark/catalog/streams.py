"""Streaming queries: a file stream run to its end, checked against the batch form."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.catalog.sequences import LATCH
from trajspark.plans.shared import shared_folder
from trajspark.plans.tables import table
from trajspark.streaming import scans

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a file stream."""
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")


def _run(stream: DataFrame) -> DataFrame:
    """The whole output of a stream, stored in the shared folder and read back."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    scans.write_batches(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out/*")


@query("select user_id, event_id, value as now, coalesce(lag(value, 2) over (partition by user_id order by ts, event_id), first_value(value) over (partition by user_id order by ts, event_id)) before from events")
def stream_history(spark: SparkSession, folder: str) -> DataFrame:
    """The last three readings kept per user, filled with the first (102, 174)."""
    step = scans.history(["user_id", "event_id"], "value", 3, [-2, 0])
    out = scans.stream_scan(_events(spark, folder).select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], step, "user_id long, event_id long, history array<double>", ["user_id", "event_id", "history"])
    return _run(out).select("user_id", "event_id", F.col("history")[1].alias("now"), F.col("history")[0].alias("before"))


_RUNS = "e as (select *, event_type = 'error' d from events), r as (select *, coalesce(sum(d::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) run from e), n as (select *, row_number() over (partition by user_id, run order by ts, event_id) steps, max(value) over (partition by user_id, run order by ts, event_id) reward from r)"


@query(f"with {_RUNS} select user_id, event_id, steps::bigint steps, reward, d as done from n where d or steps % 4 = 0")
def stream_reward(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of four steps with the greatest reward since the run began; errors end a run (173, 180)."""
    step = scans.episode_reward(["user_id", "event_id"], "value", "d", 4)
    rows = _events(spark, folder).select("user_id", "ts", "event_id", "value", (F.col("event_type") == "error").alias("d"))
    out = scans.stream_scan(rows, ["user_id"], ["ts", "event_id"], step, "user_id long, event_id long, reward double, steps long, done boolean", ["user_id", "event_id", "reward", "steps", "done"])
    return _run(out)


@query("with p as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 i from events) select p.user_id, p.event_id, round(q.value + (p.i % 3), 6) x from p join p q on q.user_id = p.user_id and q.i = p.i - p.i % 3")
def stream_replan(spark: SparkSession, folder: str) -> DataFrame:
    """A plan of three values carried out, then the next one (175, 183)."""
    step = scans.replan(["user_id", "event_id"], "plan", 3)
    rows = _events(spark, folder).select("user_id", "ts", "event_id", F.array(*[F.col("value") + k for k in range(3)]).alias("plan"))
    out = scans.stream_scan(rows, ["user_id"], ["ts", "event_id"], step, "user_id long, event_id long, vector array<double>", ["user_id", "event_id", "vector"])
    return _run(out).select("user_id", "event_id", F.round(F.col("vector")[0], 6).alias("x"))


@query(
    "with recursive x as (select user_id, ts, event_id, value % 1.0 g from events), "
    + LATCH.format(key="user_id", order="ts, event_id", at="event_id", of="o.user_id, o.event_id", same="o.user_id = s.user_id")
    + " select user_id, event_id, round(latched, 6) latched from s"
)
def stream_latch(spark: SparkSession, folder: str) -> DataFrame:
    """The sticky gripper over a stream (179)."""
    step = scans.latch(["user_id", "event_id"], "x", 5)
    rows = _events(spark, folder).select("user_id", "ts", "event_id", (F.pmod(F.col("value"), F.lit(1.0))).alias("x"))
    out = _run(scans.stream_scan(rows, ["user_id"], ["ts", "event_id"], step, "user_id long, event_id long, latched double", ["user_id", "event_id", "latched"]))
    return out.withColumn("latched", F.round("latched", 6))
