"""Distributed writers and scans of stored data sets, and files by path or URI."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trajspark.plans import files
from trajspark.sources import datasets, layouts


def test_files_appear_whole_under_their_names(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i % 5}/f{i % 2}.parquet" if i % 11 else None, 99 - i, f"t{i}", [1.0 * i]) for i in range(100)], "at string, i long, `a.b` string, v array<double>").repartition(6)
    got = {r["path"]: r["n_rows"] for r in layouts.write_files(df.select("i", "`a.b`", "v", "at"), str(tmp_path), F.col("at"), ["i"]).collect()}
    assert len(got) == 10 and sum(got.values()) == 90
    for path, n in got.items():
        t = pq.read_table(tmp_path / path)
        assert t.num_rows == n and t.column_names == ["i", "a.b", "v", "at"] and t["i"].to_pylist() == sorted(t["i"].to_pylist())
    assert not [p for p in tmp_path.rglob("_*")]
    again = layouts.write_files(df.where("i < 50"), str(tmp_path), F.col("at"), ["i"]).collect()  # replaces
    assert all(pq.read_table(tmp_path / r["path"]).num_rows == r["n_rows"] for r in again)
    assert layouts.write_files(df.where("false"), str(tmp_path / "none"), F.col("at"), ["i"]).count() == 0


def test_lines(spark, tmp_path):
    df = spark.createDataFrame([(i, f'{{"x": {i}}}') for i in (3, 1, 2)], "o int, line string")
    layouts.write_files(df, str(tmp_path), F.lit("meta/e.jsonl"), ["o"], lines=True)
    assert (tmp_path / "meta/e.jsonl").read_text() == '{"x": 1}\n{"x": 2}\n{"x": 3}\n'


def test_slices_fall_back_on_the_index(spark):
    rows = [("d", e, "f", r) for r, e in enumerate([0, 0, 0, 1, 1, 2, 1, 2])]
    frames = spark.createDataFrame(rows, "dataset string, episode_index long, path string, row long")
    eps = spark.createDataFrame([("d", 0, "f", 10, 13), ("d", 1, "f", 13, 16), ("d", 2, "f", 16, 19)], "dataset string, episode_index long, path string, `from` long, `to` long")
    got = {r["episode_index"]: (r["n_slice"], r["n_rows"], r["fallback"]) for r in layouts.episode_slices(frames, eps).collect()}
    assert got == {0: (3, 3, False), 1: (3, 3, True), 2: (2, 2, True)}
    assert layouts.episode_slices(frames.where("false"), eps).where("fallback").count() == 3


def test_files_by_path_and_uri(tmp_path):
    for uri in (str(tmp_path / "a/x.json"), f"file://{tmp_path}/b/x.json"):
        files.write(uri, b"{}")
        assert files.read(uri) == b"{}" and files.exists(uri) and not files.is_folder(uri)
    assert files.matching(f"{tmp_path}/*/x.json") == [f"{tmp_path}/a/x.json", f"{tmp_path}/b/x.json"]
    assert files.matching(f"file://{tmp_path}/[b]/x.json") == [f"file://{tmp_path}/b/x.json"]
    assert files.matching(f"{tmp_path}/none/*") == [] and files.matching("plain") == ["plain"]
    assert datasets.expand([f"{tmp_path}/*:{tmp_path}/a"]) == [f"{tmp_path}/a", f"{tmp_path}/b"]
    with pytest.raises(FileNotFoundError):
        files.read(str(tmp_path / "none"))


def test_conversion_keeps_statistics_and_other_files(spark, tmp_path):
    root = tmp_path / "d"
    for p in ("data/chunk-000", "meta/episodes/chunk-000", "images"):
        (root / p).mkdir(parents=True)
    import pyarrow as pa

    pq.write_table(pa.table({"episode_index": [0, 0, 1], "frame_index": [0, 1, 0], "observation.state": [[1.0], [2.0], [3.0]]}), root / "data/chunk-000/file-000.parquet")
    pq.write_table(pa.table({"episode_index": [0, 1], "dataset_from_index": [0, 2], "dataset_to_index": [2, 3], "tasks": [["t"], ["t"]], "stats/action/mean": [[0.5], [1.5]], "stats/action/count": [2, 1]}), root / "meta/episodes/chunk-000/file-000.parquet")
    pq.write_table(pa.table({"task_index": [0], "task": ["t"]}), root / "meta/tasks.parquet")
    (root / "meta/info.json").write_text(json.dumps({"codebase_version": "v3.0", "total_episodes": 2, "features": {}}))
    (root / "images/note.txt").write_text("kept")
    for _ in range(2):  # the second run keeps what the first wrote under another name
        datasets.convert(spark, str(root), str(tmp_path / "o"), chunks_size=1)
    assert pq.read_table(tmp_path / "o/data/chunk-001/episode_000001.parquet").column_names == ["episode_index", "frame_index", "observation.state"]
    lines = [json.loads(x) for x in (tmp_path / "o/meta/episodes_stats.jsonl").read_text().splitlines()]
    assert lines[1] == {"episode_index": 1, "stats": {"action": {"mean": [1.5], "count": 1}}}
    assert (tmp_path / "o/images/note.txt").read_text() == "kept" and len(list(tmp_path.glob("o.backup-*"))) == 1


def test_repair_refuses_to_empty_and_forgets_caches(spark, tmp_path):
    from trajspark.sources.repair import repair_store

    for ds, there in (("a", (0, 2)), ("b", (9,)), ("c", (0, 1, 2))):
        for e in (0, 1, 2, 9):
            p = tmp_path / ds / f"data/chunk-000/episode_{e:06d}.parquet"
            p.parent.mkdir(parents=True, exist_ok=True)
            if e in there:
                p.write_bytes(b"x")
        meta = tmp_path / ds / "meta"
        meta.mkdir()
        (meta / "info.json").write_text(json.dumps({"chunks_size": 1000, "total_episodes": 3, "splits": {"train": "0:3"}, "kept": 1}))
        (meta / "episodes.jsonl").write_text("\n\n".join(json.dumps({"episode_index": e, "length": 5 + e, "note": "x"}) for e in (0, 1, 2)))
        (meta / "stats.json").write_text("{}")
    dry = {r["dataset"]: (r["kept"], r["dropped"], r["refused"]) for r in repair_store(spark, str(tmp_path), dry_run=True).collect()}
    assert dry == {"a": (2, 1, False), "b": (3, 0, True), "c": (3, 0, False)}
    assert (tmp_path / "a/meta/stats.json").exists() and len((tmp_path / "a/meta/episodes.jsonl").read_text().split()) > 8
    assert {r["dataset"]: (r["kept"], r["dropped"], r["refused"]) for r in repair_store(spark, str(tmp_path)).collect()} == dry
    assert [json.loads(x) for x in (tmp_path / "a/meta/episodes.jsonl").read_text().splitlines()] == [{"episode_index": e, "length": 5 + e, "note": "x"} for e in (0, 2)]
    assert json.loads((tmp_path / "a/meta/info.json").read_text()) == {"chunks_size": 1000, "total_episodes": 2, "total_frames": 12, "total_chunks": 1, "splits": {"train": "0:2"}, "kept": 1}
    assert not (tmp_path / "a/meta/stats.json").exists() and (tmp_path / "b/meta/stats.json").exists() and (tmp_path / "c/meta/stats.json").exists()


def test_pipelines():
    import numpy as np

    from trajspark.functions import images

    x = np.arange(64, dtype=np.uint8).reshape(8, 8, 1)
    assert (images.resize(x, 8, 8, linear=True) == x).all()
    assert (images.resize(x.astype(float), 4, 4, linear=True)[1, 1] == x[2:4, 2:4].mean()).all()
    up = images.resize(x[:, :, 0], 16, 16, linear=True)
    assert up.shape == (16, 16) and up[0, 0] == 0 and up[-1, -1] == 63
    run = images.training_pipeline(0.75, 8, 8, 0.3, 0.4)
    a, b = run(x, images.sample_rng("s")), run(x, images.sample_rng("t"))
    assert a.shape == (8, 8, 1) and a.dtype == np.uint8 and (a == run(x, images.sample_rng("s"))).all() and not (a == b).all()
    e = images.evaluation_pipeline(0.5, 4, 4)
    assert (e(x, None) == x[2:6, 2:6]).all()


def test_messages_and_requirements(spark):
    from trajspark.functions import text

    df = spark.createDataFrame([("Foo_Bar.baz[a,b]  >=1.0, <2 ; python_version<'3' # note",), ("plain",), ("",)], "t string")
    got = [tuple(r[0]) for r in df.select(text.requirement(F.col("t"))).collect()]
    assert got == [("foo-bar-baz", ">=1.0,<2", "python_version<'3'"), ("plain", "", ""), ("", "", "")]
    one = spark.range(1).select(text.only_message(F.array(F.lit("step"))).alias("m")).first()[0]
    assert one == "step"
    with pytest.raises(Exception, match="one message expected, not 2"):
        spark.range(1).select(text.only_message(F.array(F.lit("step"), F.lit("end")))).collect()
