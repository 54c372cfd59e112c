import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trajspark.functions import images
from trajspark.sources import datasets, ndarrays, video


def _meta(root, info, episodes=None, tasks=None, modality=None, stats=None):
    os.makedirs(f"{root}/meta", exist_ok=True)
    for name, data in (("info", info), ("modality", modality or {}), ("stats", stats)):
        if data is not None:
            with open(f"{root}/meta/{name}.json", "w") as f:
                json.dump(data, f)
    for name, rows in (("episodes", episodes), ("tasks", tasks)):
        if rows is not None:
            with open(f"{root}/meta/{name}.jsonl", "w") as f:
                f.write("\n\n".join(json.dumps(r) for r in rows) + "\n")


MODALITY = {"state": {"arm": {"start": 0, "end": 2}, "gripper": {"start": 2, "end": 9}}, "action": {"arm": {"start": 0, "end": 1, "original_key": "command"}}, "annotation": {"task": {"original_key": "task_index"}}, "video": {"front": {"original_key": "images.front"}}}


def _rows(e, n, index=True):
    t = {"frame_index": list(range(n)), "timestamp": [i / 10 for i in range(n)], "task_index": [0] * n, "observation.state": [[float(e), float(i), 1.0] for i in range(n)], "command": [[float(i)] for i in range(n)], "unused": ["x"] * n}
    return pa.table(t | ({"episode_index": [e] * n} if index else {}))


def _old(root):
    _meta(root, {"codebase_version": "v2.1", "chunks_size": 2}, [{"episode_index": e, "length": n, "tasks": ["t"]} for e, n in ((0, 4), (1, 3), (2, 5))], [{"task_index": 0, "task": "t"}], MODALITY, {"command": {"mean": [1]}, "__fingerprints__": {"command": "x"}})
    for e, n in ((0, 4), (1, 3), (2, 5)):
        p = f"{root}/data/chunk-{e // 2:03d}"
        os.makedirs(p, exist_ok=True)
        pq.write_table(_rows(e, n, index=True), f"{p}/episode_{e:06d}.parquet")


def _new(root):
    feats = {"command": {"dtype": "float32", "fps": 10}, "images.front": {"dtype": "video", "fps": 10}}
    _meta(root, {"codebase_version": "v3.0", "total_episodes": 3, "data_files_size_in_mb": 1, "features": feats}, modality=MODALITY)
    os.makedirs(f"{root}/data/chunk-000")
    os.makedirs(f"{root}/meta/episodes/chunk-000")
    pq.write_table(pa.concat_tables([_rows(0, 4), _rows(1, 3)]), f"{root}/data/chunk-000/file-000.parquet")
    pq.write_table(_rows(2, 5), f"{root}/data/chunk-000/file-001.parquet")
    pq.write_table(pa.table({"episode_index": [2, 0, 1], "dataset_from_index": [7, 0, 4], "dataset_to_index": [12, 4, 7], "tasks": [["t"]] * 3, "stats/command/mean": [[1.0]] * 3}), f"{root}/meta/episodes/chunk-000/file-000.parquet")
    import pandas as pd

    pd.DataFrame({"task_index": [0]}, index=pd.Index(["pick"])).to_parquet(f"{root}/meta/tasks.parquet")


def test_older_layout(spark, tmp_path):
    _old(str(tmp_path / "d"))
    d = datasets.Dataset(spark, str(tmp_path / "d"))
    assert d.version == 2 and d.stats() == {"command": {"mean": [1]}}
    assert [r["length"] for r in d.episodes().collect()] == [4, 3, 5]
    assert [tuple(r) for r in d.tasks().collect()] == [(0, "t")]
    assert "unused" not in d.needed_columns() and "command" in d.needed_columns()
    with pytest.raises(KeyError):
        d.needed_columns({"state": ["nothing"]})
    f = d.frames(episodes=[2])
    assert f.count() == 5
    g = d.groups(f, "state").orderBy("frame_index").select("`state.arm`", "`state.gripper`").first()
    assert g[0] == [2.0, 0.0] and g[1] == [1.0]
    with pytest.raises(KeyError):
        d.groups(f.drop("command"), "action")
    assert "action.arm" not in d.groups(f.drop("command"), "action", strict=False).columns
    assert [r["dataset"].endswith("/d") for r in datasets.discover(spark, str(tmp_path)).collect()] == [True]
    assert {r["path"] for r in datasets.file_index(spark, str(tmp_path / "d")).collect()} == {f"data/chunk-{e // 2:03d}/episode_{e:06d}.parquet" for e in range(3)}
    assert datasets.column_of(spark, str(tmp_path / "d" / "data"), "unused").count() == 12


def test_file_names_stand_in_for_the_episode(spark, tmp_path):
    root = str(tmp_path / "d")
    _meta(root, {}, [{"episode_index": 3, "length": 4}], [], MODALITY)
    os.makedirs(f"{root}/data/chunk-000")
    pq.write_table(_rows(3, 4, index=False), f"{root}/data/chunk-000/episode_000003.parquet")
    d = datasets.Dataset(spark, root)
    assert {r["episode_index"] for r in d.frames().collect()} == {3} and d.check_counts(d.frames()).count() == 0


def test_newer_layout_and_conversion(spark, tmp_path):
    _new(str(tmp_path / "n"))
    d = datasets.Dataset(spark, str(tmp_path / "n"))
    assert d.version == 3 and "stats/command/mean" not in d.episodes().columns
    assert [r["episode_index"] for r in d.episodes().collect()] == [0, 1, 2]
    assert [tuple(r) for r in d.tasks().collect()] == [(0, "pick")]
    assert d.frames(episodes=[1]).count() == 3 and d.check_counts(d.frames()).count() == 0
    bad = d.check_counts(d.frames().where("episode_index <> 1 or frame_index > 0")).collect()
    assert [(r["episode_index"], r["n"], r["expected"]) for r in bad] == [(1, 2, 3)]
    datasets.convert(spark, str(tmp_path / "n"), str(tmp_path / "o"), chunks_size=2)
    o = datasets.Dataset(spark, str(tmp_path / "o"))
    assert o.version == 2 and o.info["total_chunks"] == 2 and o.info["total_videos"] == 3 and "fps" not in o.info["features"]["command"] and "data_files_size_in_mb" not in o.info
    assert sorted(p.name for p in (tmp_path / "o" / "data" / "chunk-000").iterdir()) == ["episode_000000.parquet", "episode_000001.parquet"]
    assert pq.read_table(tmp_path / "o/data/chunk-001/episode_000002.parquet").column("frame_index").to_pylist() == list(range(5))
    assert [r["length"] for r in o.episodes().collect()] == [4, 3, 5] and o.frames().count() == 12
    with pytest.raises(ValueError):
        datasets.convert(spark, str(tmp_path / "o"), str(tmp_path / "x"))
    datasets.convert(spark, str(tmp_path / "n"), str(tmp_path / "o"))  # the earlier result is kept beside it
    assert len([p for p in tmp_path.iterdir() if ".backup-" in p.name]) == 1


def test_small_parts():
    assert [datasets.major_version({"codebase_version": v}) for v in ("v3.1", "2.0", "draft", None)] == [3, 2, 2, 2]
    assert datasets.nested_stats({"stats/a/mean": 1, "stats/a/b/c": 2, "x": 3}) == {"a": {"mean": 1, "b/c": 2}}


def test_expand(tmp_path):
    for n in "abc":
        (tmp_path / n).mkdir()
    assert datasets.expand([f"{tmp_path}/a{os.pathsep}{tmp_path}/b", f"{tmp_path}/*"]) == [f"{tmp_path}/{n}" for n in "abc"]


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.arange(12, dtype=np.uint8).reshape(3, 4))
    np.savez(tmp_path / "many.npz", np.arange(24, dtype=np.int32).reshape(2, 3, 4))
    df = ndarrays.read_arrays(spark, str(tmp_path))
    rows = {(os.path.basename(r["path"]), r["frame"]): np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"]) for r in df.collect()}
    assert sorted(rows) == [("many.npz", 0), ("many.npz", 1), ("one.npy", 0)]
    np.testing.assert_array_equal(rows["many.npz", 1], np.arange(12, 24).reshape(3, 4))
    assert ndarrays.read_arrays(spark, str(tmp_path / "many.npz"), [1]).count() == 1
    with pytest.raises(ValueError):
        ndarrays.load_array("x.png")
    np.savez(tmp_path / "two.npz", a=np.zeros(1), b=np.zeros(1))
    with pytest.raises(ValueError):
        ndarrays.load_array(str(tmp_path / "two.npz"))


def test_initial_actions(spark, tmp_path):
    path = str(tmp_path / "a.npz")
    ndarrays.save_initial_actions([{"t0": {"arm": np.array([[1.0, 2.0], [3.0, 4.0]])}}, {}], path)
    assert [tuple(r) for r in ndarrays.load_initial_actions(spark, path).orderBy("row").collect()] == [(0, "t0", "arm", 0, [1.0, 2.0]), (0, "t0", "arm", 1, [3.0, 4.0])]
    again = str(tmp_path / "b.npz")
    ndarrays.save_initial_actions([{}, {"t": {"arm": np.array([5.0, 6.0])}}], again, owner="someone")
    back = ndarrays.read_initial_actions(again)
    assert back[0] == {} and len(back) == 2 and back[1]["t"]["arm"].shape == (2,)
    assert {r["dataset"]: r["vec"] for r in ndarrays.load_initial_actions(spark, [path, again]).where("row = 0").collect()} == {0: [1.0, 2.0], 3: [5.0, 6.0]}
    with np.load(again) as z:
        assert json.loads(bytes(z["__schema__"])) == {"format": "someone.initial_actions", "version": 1, "key_sep": "::", "num_datasets": 2}
    with pytest.raises(ValueError):
        ndarrays.save_initial_actions([{"a::b": {"k": np.zeros(1)}}], path)
    np.savez(path, x=np.zeros(1))
    with pytest.raises(ValueError):
        ndarrays.load_initial_actions(spark, path)


def test_video(spark, tmp_path):
    stack = np.arange(5 * 2 * 3 * 3, dtype=np.uint8).reshape(5, 2, 3, 3)
    np.save(tmp_path / "v.npy", stack)
    need = spark.createDataFrame([(str(tmp_path / "v.npy"), i) for i in (3, 1, 3, 9)] + [(None, 1)], "path string, frame long")
    got = {r["frame"]: r for r in video.decode(need, missing="black").collect()}
    assert sorted(got) == [1, 3, 9] and got[3]["data"] == stack[3].tobytes() and not any(got[9]["data"])
    assert (video.frames_at("x", [9], lambda p: (stack, 1.0), "repeat")[0] == stack[-1]).all()
    with pytest.raises(IndexError):
        video.frames_at("x", [9], lambda p: (stack, 1.0))
    assert video.snap(np.array([0.0, 0.1, 0.25 + 0.05]), 10).tolist() == [0, 1, 3]
    with pytest.raises(ValueError):
        video.snap(np.array([0.05]), 10)
    assert video.probe("30000/1001", None, 2.0) == (pytest.approx(29.97, abs=0.01), 59) and video.probe("30", 7, None) == (30.0, 7)
    assert video.backend_of("a.npy") == ("npy", None) and video.backend_of("a.npy", codec="av1")[1]
    with pytest.raises(ValueError):
        video.backend_of("a.mp4")
    with pytest.raises(ValueError):
        video.register("npy", lambda p: (stack, 1.0))
    df = spark.createDataFrame([(3, 0.05, 10.0), (3, 0.15, 10.0)], "i long, t double, fps double")
    assert [r[0] for r in df.select(video.addressed(F.col("i"), F.col("t"), F.col("fps"))).collect()] == [3, 5]


def test_images(spark, tmp_path):
    x = np.arange(5 * 4 * 3, dtype=np.uint8).reshape(5, 4, 3)
    box = images.letterbox(np.ones((3, 6, 3), np.uint8))
    assert box.shape == (6, 6, 3) and box[:, 0, 0].tolist() == [0, 1, 1, 1, 0, 0]
    assert images.crop(x, 0.5).shape == (2, 2, 3) and images.crop(x, 0.01).shape == (1, 1, 3)
    assert images.to_uint8(np.array([0.0, 0.5, 1.0])).tolist() == [0, 127, 255]
    assert images.resize_pad(x, 10, 10).shape == (10, 10, 3) and images.beside(x, x[:, :2]).shape[0] == 4
    mask = np.zeros((5, 4))
    mask[0] = 1
    y = images.masked_noise(x, mask, images.sample_rng("a"))
    assert (y[0] == x[0]).all() and (y == images.masked_noise(x, mask, images.sample_rng("a"))).all()
    assert (images.masked_tint(x, mask, np.array([9, 9, 9]), 1.0)[1:] == 9).all()
    assert (images.flip_vertical(x)[0] == x[-1]).all()
    np.save(tmp_path / "v.npy", np.stack([x, x]))
    frames = video.decode(spark.createDataFrame([(str(tmp_path / "v.npy"), i) for i in (0, 1)], "path string, frame long"))
    out = images.apply(frames, lambda im, rng: images.crop(im, 0.5, tuple(rng.random(2))), "path").collect()
    assert len(out) == 2 and out[0]["data"] == out[1]["data"] and (out[0]["h"], out[0]["w"]) == (2, 2)  # both frames are cut alike


def test_many_small_arrays_are_read_by_few_tasks(spark, tmp_path):
    for i in range(600):
        np.save(tmp_path / f"{i:03d}.npy", np.full((2, 1, 3), i % 2, np.uint8))
    df = ndarrays.read_arrays(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert len({(r["path"], r["frame"]) for r in rows}) == len(rows) == 1200
    assert all(bytes(r["data"]) == bytes([int(os.path.basename(r["path"])[:3]) % 2]) * 3 and (r["h"], r["w"], r["c"]) == (1, 3, 1) for r in rows)
    assert [len(p.paths) for p in ndarrays._shared_out(["a", "b", "c"], [ndarrays.BYTES_A_TASK, 1, 1])] == [1, 2]
