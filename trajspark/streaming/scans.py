"""Stateful scans: per key, rows in order through a step function, in a stream or in a batch.

A step is a function (state, row) -> (state, rows out) with a JSON-able state, so that the same
code runs as a Structured Streaming operator, where the state is kept between micro-batches, and
over a static DataFrame, against which the stream is tested.
"""

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict, dict], tuple[dict, list[dict]]]


def _walk(step: Step, state: dict, pdf: pd.DataFrame, order: list[str], names: list[str]) -> tuple[dict, pd.DataFrame]:
    out = []
    for row in pdf.sort_values(order).to_dict("records"):
        state, rows = step(state, row)
        out += rows
    return state, pd.DataFrame(out, columns=names)


def stream_scan(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, names: list[str]) -> DataFrame:
    """A stream through `step`: the rows of a micro-batch are taken in order within each key, and the
    state is carried to the next. Rows must not arrive later than rows that follow them in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {}
        now, out = _walk(step, now, pd.concat(list(batches)), order, names)
        state.update((json.dumps(now),))
        yield out

    return df.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def batch_scan(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, names: list[str]) -> DataFrame:
    """The same over a static DataFrame."""
    return df.groupBy(*keys).applyInPandas(lambda pdf: _walk(step, {}, pdf, order, names)[1], schema)


def history(keep: list[str], value: str, size: int, offsets: list[int]) -> Step:
    """The values at `offsets` (0 the newest, negative before) of the last `size`, filled with the first."""

    def step(state: dict, row: dict):
        held = state.get("h") or [row[value]] * size
        held = [*held, row[value]][-size:]
        return {"h": held}, [{k: row[k] for k in keep} | {"history": [held[o - 1] for o in offsets]}]

    return step


def episode_reward(keep: list[str], reward: str, done: str, actions: int, method: str = "max", most: int | None = None) -> Step:
    """Execution in chunks of `actions` steps: after each chunk, or at the end, the reward over the whole
    episode so far; an episode that is done, or has `most` steps, starts anew with the next row."""
    join = {"max": max, "min": min, "mean": lambda a, b: a + b, "sum": lambda a, b: a + b}[method]

    def step(state: dict, row: dict):
        # the state is one number however long the episode is
        steps, since, x = state.get("s", 0) + 1, state.get("n", 0) + 1, float(row[reward])
        so_far = join(state["r"], x) if "r" in state else x
        over = bool(row[done]) or (most is not None and steps >= most)
        out = []
        if over or since == actions:
            out = [{k: row[k] for k in keep} | {"reward": so_far / steps if method == "mean" else so_far, "steps": steps, "done": over}]
            since = 0
        return ({} if over else {"r": so_far, "s": steps, "n": since}), out

    return step


def replan(keep: list[str], plan: str, steps: int) -> Step:
    """A receding horizon: a plan is carried out for `steps` rows, then the row's own plan replaces it."""

    def step(state: dict, row: dict):
        todo = state.get("p") or [list(map(float, np.atleast_1d(v))) for v in row[plan][:steps]]
        return {"p": todo[1:]}, [{k: row[k] for k in keep} | {"vector": todo[0]}]

    return step


def ensemble(keep: list[str], plan: str, most: int = 5, rate: float = 0.005, newest: tuple[int, ...] = (), every: int = 1) -> Step:
    """Overlapping plans blended: the newest `most` weighted exp(rate * k), exhausted ones dropped;
    a new one is taken in at every `every`-th row; the dimensions `newest` are the newest plan's."""

    def step(state: dict, row: dict):
        active, at = state.get("a", []), state.get("t", 0)
        if at % every == 0:
            active = [*active, [list(map(float, np.atleast_1d(v))) for v in row[plan]]][-most:]
        first = np.array([p[0] for p in active])
        w = np.exp(rate * np.arange(len(active)))
        v = (w[:, None] * first).sum(0) / w.sum()
        for k in newest:
            v[k] = first[-1, k]
        active = [p[1:] for p in active if len(p) > 1]
        return {"a": active, "t": at + 1}, [{k: row[k] for k in keep} | {"vector": v.tolist()}]

    return step


def latch(keep: list[str], value: str, repeat: int, threshold: float = 0.5) -> Step:
    """The sticky gripper: 1 - 2x latched when its size exceeds the threshold, held for `repeat` rows."""

    def step(state: dict, row: dict):
        held, n = state.get("v"), state.get("n", 0)
        v = 1 - 2 * float(row[value])
        if held is None and abs(v) > threshold:
            held = v
        if held is not None:
            n, v = n + 1, held
        if n == repeat:
            held, n = None, 0
        return {"v": held, "n": n}, [{k: row[k] for k in keep} | {"latched": v}]

    return step


def resample(keep: list[str], time: str, start: float, dt: float, eps: float = 1e-5, first: int | None = 0, allow_negative: bool = False) -> Step:
    """Grid slots filled as rows arrive; the next slot to fill is the state."""

    def step(state: dict, row: dict):
        nxt = state["next"] if "next" in state else first
        g = int(np.floor((float(row[time]) - start) / dt + eps))
        if g < 0 and not allow_negative:
            return state, []
        nxt = g if nxt is None else nxt
        out = [{k: row[k] for k in keep} | {"slot": s} for s in range(nxt, g + 1)]
        return {"next": max(nxt, g + 1)}, out

    return step


def write_batches(df: DataFrame, path: str, checkpoint: str):
    """A sink that writes each micro-batch to a folder of its own, so that a repeated batch replaces itself."""
    return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch={i}")).start()
