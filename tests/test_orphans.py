from datetime import datetime as D

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajspark.functions.bitmaps import KeyBits
from trajspark.functions.paths import fill_path, plain_path
from trajspark.operators.orphans import dangling, orphan_references, orphan_report

FRAMES = "dataset_id string, episode_index long, task_index long, received_at timestamp, state string"
EPISODES = "dataset_id string, episode_index long, received_at timestamp, deleted_at timestamp"
TASKS = "dataset_id string, task_index long, received_at timestamp, deleted_at timestamp"
INFO = "dataset_id string, revision int, video_path string, chunks_size long"
MODALITY = "dataset_id string, modality string, original_key string"
FILES = "dataset_id string, kind string, path string, received_at timestamp, deleted_at timestamp"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 32767), max_size=60), st.sets(st.integers(0, 32767), max_size=60), st.booleans(), st.booleans())
def test_bitmaps_are_sets(a, b, wide_a, wide_b):
    a = a | set(range(5000, 9000)) if wide_a else a
    b = b | set(range(7000, 12000)) if wide_b else b
    x, y = KeyBits.of(np.array(sorted(a), dtype=int)), KeyBits.of(np.array(sorted(b), dtype=int))
    assert set(x.decode().tolist()) == a
    assert set(x.and_not(y).decode().tolist()) == a - b
    assert set(x.both(y).decode().tolist()) == a & b


def test_every_state(spark):
    t = lambda m, d=1, h=0: D(2024, m, d, h)
    frames = [("a", 1, 0, t(1, 5), "x"), ("a", 1, 0, t(1, 4), "x"), ("a", 1, 9, t(1, 6), "x"), ("a", 2, None, t(2), "x"), ("a", 3, 1, t(3), "x"), ("a", 4, 2, t(3, 2), "x"), ("b", 1, 0, t(3), "x"), (None, 1, 1, t(1), "x"), ("a", None, 1, t(1), "x")]
    episodes = [("a", 1, t(1, 1), None), ("a", 1, t(1, 2), None), ("a", 2, t(1), t(2)), ("a", 3, t(3, 1, 5), None), ("a", 3, t(1), t(2)), ("a", 4, t(3, 2), None), ("a", 40000, t(3, 2), None)]
    tasks = [("a", 0, t(1), None), ("a", 1, t(1), t(2)), ("a", 2, t(4), None), (None, 0, t(1), None)]
    info = [("a", 1, "old/{episode_index}.mp4", 10), ("a", 2, "v/{video_key}/c{episode_chunk:02d}/e_{episode_index:03d}.mp4", 2), ("a", 3, None, 2), ("b", 1, None, 5)]
    modality = [("a", "video", "cam.x"), ("a", "video", "cam.x"), ("a", "state", "s"), ("b", "video", "cam")]
    files = [("a", "video", "./v//cam.x/c00/e_001.mp4", t(1, 1), None), ("a", "video", "v/cam.x/c01/e_003.mp4", t(1), t(2)), ("a", "video", "v/cam.x/c02/e_004.mp4", t(5), None), ("a", "data", "v/cam.x/c20000/e_40000.mp4", t(1), None)]
    df = [spark.createDataFrame(r, s) for r, s in ((frames, FRAMES), (episodes, EPISODES), (tasks, TASKS), (info, INFO), (modality, MODALITY), (files, FILES))]
    got = {tuple(r) for r in orphan_references(*df).collect()}
    assert got == {
        ("frames", "episode_index", "a", 2, "2", "deleted", "2024-02"),
        ("frames", "episode_index", "a", 3, "3", "late", "2024-03"),
        ("frames", "episode_index", "b", 1, "1", "missing", "2024-03"),
        ("frames", "task_index", "a", 1, "9", "missing", "2024-01"),
        ("frames", "task_index", "a", 3, "1", "deleted", "2024-03"),
        ("frames", "task_index", "a", 4, "2", "late", "2024-03"),
        ("frames", "task_index", "b", 1, "0", "missing", "2024-03"),
        ("episodes", "video_path", "a", 3, "v/cam.x/c01/e_003.mp4", "deleted", "2024-03"),
        ("episodes", "video_path", "a", 4, "v/cam.x/c02/e_004.mp4", "late", "2024-03"),
        ("episodes", "video_path", "a", 40000, "v/cam.x/c20000/e_40000.mp4", "missing", "2024-03"),
    }
    assert sum(r["n"] for r in orphan_report(orphan_references(*df)).collect()) == len(got)


def test_late_is_judged_per_reference(spark):
    refs = spark.createDataFrame([("r", "d", 7, 10, "early"), ("r", "d", 7, 30, "after"), ("r", "d", None, 1, "null"), ("r", "d", 90000, 1, "far")], "relation string, dataset_id string, code long, ref_at long, who string")
    parents = spark.createDataFrame([("r", "d", 7, 20), ("r", "d", 90000, 1)], "relation string, dataset_id string, code long, live_at long")
    assert {(r["who"], r["state"]) for r in dangling(refs, parents).collect()} == {("early", "late")}
    none = parents.where("false")
    assert {(r["who"], r["state"]) for r in dangling(refs, none).collect()} == {("early", "missing"), ("after", "missing"), ("far", "missing")}
    assert dangling(refs.where("false"), parents).count() == 0


def test_paths(spark):
    df = spark.createDataFrame([("a{x:03d}b{k}", 7), ("{x}", 7), ("{y}", 7), ("p", 7), (None, 7), ("{x:02d}", 12345)], "p string, x long")
    got = [r[0] for r in df.select(fill_path(F.col("p"), {"x": F.col("x")}, {"k": F.lit("K")})).collect()]
    assert got == ["a007bK", "7", None, "p", None, "12345"]
    assert spark.range(1).select(plain_path(F.lit("././a//b///c"))).first()[0] == "a/b/c"
