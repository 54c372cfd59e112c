import io
from datetime import datetime as D

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from trajspark.operators.compaction import binned, compact, consolidate, contributions, list_files, part_plan, treatment
from trajspark.sources.parquet_blocks import concat_files, read_footer

FRAMES = "dataset_id string, episode_index long, frame_index long, data_path string, received_at timestamp"
FILES = "dataset_id string, kind string, path string, received_at timestamp, n_rows long"


def _file(table, **options):
    b = io.BytesIO()
    pq.write_table(table, b, **options)
    return b


@pytest.mark.parametrize("options", [{}, {"compression": "zstd"}, {"compression": "none", "use_dictionary": False}, {"row_group_size": 3}, {"data_page_version": "2.0", "write_page_index": True}, {"version": "1.0", "write_statistics": False}])
def test_blocks_are_copied_whole(options):
    tables = [pa.table({"a": list(range(i, i + 7)), "s": [None, "x", "y"] * 2 + ["é"], "v": [[1.0, 2.0], None, []] * 2 + [[i * 1.5]], "m": pa.array([{"k": i, "l": [str(i)]}] * 7), "b": [True, None] * 3 + [False]}) for i in (0, 100, 200)]
    out = io.BytesIO()
    done = concat_files([_file(t, **options) for t in tables], out)
    out.seek(0)
    assert pq.read_table(out).equals(pa.concat_tables(tables))
    assert done["rows"] == 21 and done["blocks"] == pq.ParquetFile(out).metadata.num_row_groups
    assert pq.read_table(out, filters=[("a", ">=", 200)]).num_rows == 7
    again = io.BytesIO()
    concat_files([out, out], again)  # an output can be put together again
    assert pq.read_table(again).num_rows == 42


def test_refusals():
    a, b = _file(pa.table({"x": [1]})), _file(pa.table({"y": [1]}))
    with pytest.raises(ValueError):
        concat_files([a, b], io.BytesIO())
    with pytest.raises(ValueError):
        concat_files([], io.BytesIO())
    for broken in (b"", b"PAR1", a.getvalue()[:-9], a.getvalue()[20:]):
        with pytest.raises((ValueError, IndexError)):
            concat_files([io.BytesIO(broken)], io.BytesIO())
    empty = io.BytesIO()
    concat_files([_file(pa.table({"x": pa.array([], pa.int64())})), a], empty)
    assert pq.read_table(empty).num_rows == 1
    assert read_footer(empty).rows == 1


def test_folder_of_small_files(spark, tmp_path):
    src = tmp_path / "in" / "part"
    src.mkdir(parents=True)
    for i in range(60):
        pq.write_table(pa.table({"i": pa.array([i] * (i % 4), pa.int64()), "t": pa.array([f"row {i}"] * (i % 4), pa.string())}), src / f"f{i:03d}.parquet")
    pq.write_table(pa.table({"other": [1]}), src / "z.parquet")
    files = list_files(spark, str(tmp_path / "in"))
    rows = compact(files, str(tmp_path / "out"), target=20_000).collect()
    assert all(r["ok"] for r in rows) and sum(r["n_files"] for r in rows) == 61 and 2 < len(rows) < 12
    got = spark.read.option("mergeSchema", "true").parquet(str(tmp_path / "out"))
    assert got.count() == sum(i % 4 for i in range(60)) + 1
    assert got.where("i is not null").groupBy("i").count().count() == 45
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_what_each_file_contributes(spark):
    t = lambda d: D(2024, 1, d)
    files = [("a", "data", "p1", t(3), 3), ("a", "data", "./p1", t(5), 3), ("a", "data", "p2", t(1), 2), ("a", "data", "p3", t(4), None), ("a", "data", "p4", t(9), 0), ("a", "data", "q0", t(3), 1), ("a", "video", "v", t(1), None), ("b", "data", "p1", t(9), 1)]
    frames = [("a", 1, 0, "p2"), ("a", 1, 1, "p2"), ("a", 1, 1, "p1"), ("a", 1, 2, "p1"), ("a", 1, 2, ".//p1"), ("a", 1, 0, "p3"), ("a", 1, 2, "p3"), ("a", 1, 40000, "q0"), ("b", 1, 0, "p1"), ("a", 2, 0, "unlisted"), ("a", None, 0, "p3"), (None, 1, 0, "p3")]
    f = spark.createDataFrame([(*r, t(1)) for r in frames], FRAMES)
    got = {(r["dataset_id"], r["data_path"]): (r["n_rows"], r["n_frames"], r["n_new"], r["treatment"]) for r in treatment(contributions(f, spark.createDataFrame(files, FILES))).collect()}
    assert got == {("a", "p1"): (3, 2, 1, "rewrite"), ("a", "p2"): (2, 2, 2, "copy"), ("a", "p3"): (2, 2, 0, "drop"), ("a", "p4"): (0, 0, 0, "drop"), ("a", "q0"): (1, 1, 1, "copy"), ("b", "p1"): (1, 1, 1, "copy")}
    assert contributions(f.where("false"), spark.createDataFrame([], FILES)).count() == 0


def test_bins(spark):
    df = spark.createDataFrame([("d", f"x/{i:03d}", 10) for i in range(20)], "dataset_id string, path string, n_bytes long")
    sizes = [r["count"] for r in binned(df, 200, 50, ["dataset_id"], "path").groupBy("bin").count().collect()]
    assert sizes == [5, 5, 5, 5]
    assert len({r["bin"][:6] for r in binned(df, 8000, 50, ["path"], "path").collect()}) > 5  # ranges grow with the bytes


def test_every_record_once_in_the_consolidated_files(spark, tmp_path):
    t = lambda d: D(2024, 1, d)
    files = [("a", "data", "p1", t(3), 3), ("a", "data", "p2", t(1), 2), ("a", "data", "p3", t(4), None), ("b", "data", "p1", t(9), 1)]
    rows = [("a", 1, 0, "p2"), ("a", 1, 1, "p2"), ("a", 1, 1, "p1"), ("a", 1, 2, "p1"), ("a", 1, 2, ".//p1"), ("a", 1, 0, "p3"), ("a", 1, 2, "p3"), ("a", 1, 40000, "p1"), ("b", 1, 0, "p1"), ("a", 2, 0, "unlisted"), ("a", 1, 0, "unlisted"), ("a", 3, 7, None), ("a", None, 0, "p3"), (None, 1, 0, "p3")]
    rows += [("a", 5, i, "p1") for i in range(100)] + [("a", 5, i, "p3") for i in range(50, 170)]
    df = spark.createDataFrame([(*r, t(1)) for r in rows], FRAMES)
    done, account = consolidate(df, spark.createDataFrame(files, FILES), str(tmp_path / "out"))
    done = done.collect()
    went = {(r["dataset_id"], r["file"], r["piece"], r["bucket"]): (r["treatment"], r["n_rows"], r["n_left"], r["out_path"] is not None) for r in account.collect()}
    assert went["a", "p2", 0, 0] == ("copy", 2, 2, True) and went["a", "p3", 0, 0] == ("rewrite", 122, 70, True) and went["a", "p1", 0, 0][0] == "rewrite" and went["a", "p1", 0, 1] == ("copy", 1, 1, True)
    got = [(r[0], r[1], r[2], (r[3] or "").replace(".//", "")) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = {("a", 1, 0): "p2", ("a", 1, 1): "p2", ("a", 1, 2): "p1", ("a", 1, 40000): "p1", ("b", 1, 0): "p1", ("a", 2, 0): "unlisted", ("a", 3, 7): ""} | {("a", 5, i): "p1" if i < 100 else "p3" for i in range(170)}
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want
    assert sum(r["n_rows"] for r in done) == len(want) and all(r["ok"] for r in done)
    none, nothing = consolidate(df.where("false"), spark.createDataFrame([], FILES), str(tmp_path / "none"))
    assert none.count() == nothing.count() == 0
    # the outputs are files to copy themselves: consolidating again keeps every record
    again, kept = consolidate(spark.read.parquet(str(tmp_path / "out")), spark.createDataFrame(files, FILES), str(tmp_path / "again"))
    assert sum(r["n_rows"] for r in again.collect()) == len(want) and {r["treatment"] for r in kept.collect()} == {"copy"}


def test_many_outputs_are_copied_by_many_tasks(spark, tmp_path):
    rows = [(f"d{i % 7}", i // 50, i % 50, f"f{i // 50}") for i in range(20_000)]
    t = D(2024, 1, 1)
    df = spark.createDataFrame([(*r, t) for r in rows], FRAMES)
    done, _ = consolidate(df, spark.createDataFrame([], FILES), str(tmp_path / "out"), target=100_000)
    assert done.count() > 8 and sum(r["n_rows"] for r in done.collect()) == df.select("dataset_id", "episode_index", "frame_index").distinct().count()
    assert done.rdd.getNumPartitions() > 1


def test_columns_of_any_name_are_kept(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0, "p", D(2024, 1, 1), "x", 5), ("a", -70, -3, "p", D(2024, 1, 1), "y", 6)], FRAMES + ", file string, piece long")
    consolidate(df, spark.createDataFrame([], FILES), str(tmp_path / "out"))
    assert sorted((r["frame_index"], r["file"], r["piece"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(-3, "y", 6), (0, "x", 5)]


def test_p5_compact_holds_the_distinct_records(spark, data):
    from trajspark.catalog.problems import p5_compact

    n = spark.read.parquet(f"{data}/frames.parquet").select("dataset_id", "episode_index", "frame_index").dropna().distinct().count()
    assert sum(r["n_rows"] for r in p5_compact(spark, data).collect()) == n


def test_no_join_of_the_consolidation_is_a_broadcast(spark, tmp_path):
    """Bitmaps and listings compress: the size of their files doesn't tell what they take in memory."""
    t = D(2024, 1, 1)
    at = lambda name: str(tmp_path / name)
    spark.createDataFrame([("a", i // 20, i % 20, f"p{i % 3}", t) for i in range(200)] + [("a", 0, i, "p2", t) for i in range(20)], FRAMES).write.parquet(at("frames"))
    spark.createDataFrame([("a", "data", f"p{i}", t, 9) for i in range(3)], FILES).write.parquet(at("files"))
    frames, files = spark.read.parquet(at("frames")), spark.read.parquet(at("files"))
    done, account = consolidate(frames, files, at("out"))
    for df in (contributions(frames, files), part_plan(frames, files), account):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sum(r["n_rows"] for r in done.collect()) == 200 and account.count() == 3
