import json
from datetime import datetime as D

from hypothesis import given, settings
from hypothesis import strategies as st

from trajspark.operators.drift import LAYOUT, compare, fingerprint, flatten, migration, revisions, schema_changes, unified
from trajspark.plans.shared import cut

FILES = "dataset_id string, revision int, file_path string, received_at timestamp, body string"


def test_flatten():
    assert flatten('{"a": {"b": [1, {"c": 2}]}, "n": null, "e": {}}') == [("a/b", "array", '[1, {"c": 2}]'), ("n", "null", "null")]
    assert flatten('{"x": 30.0}') == flatten('{"x": 30}')
    assert flatten("[1]") == [("", "array", "[1]")]
    for bad in ("", "{", "NaN", '{"a": NaN}', "{'a': 1}", None, "[" * 100_000):
        assert flatten(bad) is None
    assert fingerprint(flatten('{"a": 1, "b": "x"}')) == fingerprint(flatten('{"b": "y", "a": 2}')) != fingerprint(flatten('{"a": "1", "b": "x"}'))


def test_changes():
    f = lambda d: flatten(json.dumps(d))
    old = {"robot": "x", "n": 5, "m": 5, "shape": [1], "f": {"shape": [1], "v": None, "k": True}, "gone": None, "t": 1, "u": 9}
    new = {"type": "x", "p": 5, "shape": [2], "f": {"shape": [2], "v": 3, "k": "yes"}, "new": None, "t": None, "q": 9, "r": 9}
    assert compare(f(old), f(new)) == sorted([("robot", "renamed", "type"), ("n", "removed", ""), ("m", "removed", ""), ("p", "added", ""), ("f/shape", "reshaped", ""), ("f/k", "retyped", ""), ("gone", "removed", ""), ("new", "added", ""), ("u", "removed", ""), ("q", "added", ""), ("r", "added", "")])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.sampled_from([1, "x", None, [1], True, 2.5]), max_size=6), st.dictionaries(st.sampled_from("abcdef"), st.sampled_from([1, "x", None, [1], True, 2.5]), max_size=6))
def test_every_path_is_accounted_for(a, b):
    out = compare(flatten(json.dumps(a)), flatten(json.dumps(b)))
    assert {p for p, c, _ in out if c in ("removed", "renamed")} == a.keys() - b.keys()
    assert {p for p, c, _ in out if c == "added"} | {n for _, c, n in out if c == "renamed"} == b.keys() - a.keys()


def test_revisions_in_order_of_number_not_arrival(spark):
    t = lambda d: D(2024, 1, d)
    rows = [("a", 1, "f", t(9), '{"x": 1}'), ("a", 4, "f", t(1), '{"y": 1}'), ("a", 2, "f", t(2), "{broken"), ("a", 3, "f", t(3), '{"x": "1"}'), ("a", 3, "f", t(4), ' {"x":\n"1"} '), ("b", 1, "f", t(1), "{}"), (None, 1, "f", t(1), "{}"), ("a", None, "f", t(1), "{}"), ("c", 1, "f", None, None)]
    v = cut(revisions(spark.createDataFrame(rows, FILES)))
    assert v.count() == 4
    got = {tuple(r) for r in schema_changes(v).collect()}
    assert got == {("a", 3, "x", "retyped", ""), ("a", 4, "x", "removed", ""), ("a", 4, "y", "added", "")}
    assert schema_changes(cut(revisions(spark.createDataFrame([], FILES)))).count() == 0


def test_one_table(spark):
    bodies = [
        {"codebase_version": 2.1, "robot": "x", "chunk_size": "50", "splits": "0:3", "fps": {"state": 30, "video": 15}, "features": {"robot_action": {"shape": 7, "dtype": "float32"}}},
        {"codebase_version": "v3.0", "embodiment": "y", "total_frames": "many", "fps": 20, "features": {"action": {"shape": [6]}}, "masks_path": "m"},
        {},
    ]
    df = spark.createDataFrame([("a", i, "f", D(2024, 1, 1), json.dumps(b)) for i, b in enumerate(bodies)], FILES)
    got = {r["revision"]: r for r in unified(revisions(df)).collect()}
    assert (got[0]["codebase_version"], got[0]["robot_type"], got[0]["chunks_size"], got[0]["train_split"], got[0]["fps"], got[0]["action_shape"]) == ("v2.1", "x", 50, "0:3", 30.0, [7])
    assert "robot -> embodiment" in got[0]["steps"] and "embodiment -> robot_type" in got[0]["steps"]
    assert (got[1]["robot_type"], got[1]["total_frames"], got[1]["uncast"], got[1]["mask_path"]) == ("y", None, ["total_frames"], "m")
    assert got[2]["chunks_size"] == 1000 and got[2]["uncast"] == []


def test_no_field_is_lost(spark):
    bodies = [
        {"robot": "x", "total_frames": "many", "features": {"index": {"shape": [1], "names": None}, "action": {"shape": [6], "names": ["a", "b"]}}, "new": {"deep": {"x": 2.5}}},
        {"robot": "x", "robot_type": "y", "kind_of_robot": "z", "action": []},
        {"features": {"action": {"shape": ["six", 7]}}},
    ]
    df = spark.createDataFrame([("a", i, "f", D(2024, 1, 1), json.dumps(b)) for i, b in enumerate(bodies)], FILES)
    got = {r["revision"]: r for r in unified(revisions(df)).collect()}
    assert got[0]["other"] == {"total_frames": '"many"', "features/index/shape": "[1]", "features/index/names": "null", "features/action/names": '["a", "b"]', "new/deep/x": "2.5"}
    assert (got[0]["robot_type"], got[0]["action_shape"], got[0]["uncast"]) == ("x", [6], ["total_frames"])
    assert got[1]["other"] == {"embodiment": '"x"', "kind_of_robot": '"z"', "action": "[]"} and got[1]["robot_type"] == "y"
    assert got[2]["uncast"] == ["action_shape"] and got[2]["other"] == {"features/action/shape": '["six", 7]'}


def test_every_field_of_the_data_is_in_the_table(spark, data):
    valid = cut(revisions(spark.read.parquet(f"{data}/info_files.parquet")))
    paths = {path for _, path, _, _ in LAYOUT}
    got = {(r["dataset_id"], r["revision"]): r for r in unified(valid).collect()}
    for r in valid.collect():
        row, renamed = got[r["dataset_id"], r["revision"]], dict(s.split(" -> ") for s in got[r["dataset_id"], r["revision"]]["steps"])
        for f in r["fields"]:
            path = f["path"]
            while path in renamed:
                path = renamed[path]
            assert row["other"].get(path) == f["value"] or path in paths and path not in row["other"]


def test_steps_are_chosen_by_schema():
    assert migration(frozenset({"a", "x"}), [("a", "b"), ("b", "c"), ("x", "c")]) == [("a", "b"), ("b", "c")]
    assert migration(frozenset({"a", "b"}), [("a", "b")]) == []
