"""Frame records, each once, and the ordering within an episode."""

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPISODE = ["dataset_id", "episode_index"]
FRAME = [*EPISODE, "frame_index"]


def frame_records(frames: DataFrame, *columns: str) -> DataFrame:
    """One row per frame record with the given columns; rows with a null key are left out.

    Repeats are dropped by key with partial aggregation; all rows of a record carry the same values.
    """
    rows = frames.where(" and ".join(f"{k} is not null" for k in FRAME))
    return rows.select(*FRAME, *[F.col(f"`{c}`").alias(_plain(c)) for c in columns]).dropDuplicates(FRAME)


def _plain(name: str) -> str:
    """A column name without dots."""
    return {"observation.state": "state", "next.reward": "reward", "next.done": "done", "timestamp": "ts"}.get(name, name)


def in_order(*order: str) -> WindowSpec:
    return Window.partitionBy(*EPISODE).orderBy(*(order or ("frame_index",)))


def live_episodes(episodes: DataFrame) -> DataFrame:
    """One row per episode that is not deleted: the one received last (ties: the longest)."""
    rows = episodes.where("deleted_at is null and dataset_id is not null and episode_index is not null")
    fields = ["length", "tasks", "sub_tasks", "operator_id", "session_id", "object_set_id"]
    return rows.groupBy(*EPISODE).agg(F.max_by(F.struct(*fields), F.struct("received_at", "length")).alias("e")).select(*EPISODE, "e.*")
