import random

from pyspark.sql import functions as F

from trajspark.llm.splits import broken_splits, components, episode_splits, in_ranges


def _find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    edges += [(2000, 2001 + i) for i in range(50)]  # one node with many neighbours
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        parent[_find(parent, a)] = _find(parent, b)
    got = {row["node"]: row["root"] for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for x in parent:
        groups.setdefault(_find(parent, x), set()).add(x)
    for g in groups.values():
        if len(g) > 1:
            assert {got[x] for x in g} == {min(g)}
        else:
            assert not g & got.keys()


EPISODES = "dataset_id string, episode_index long, operator_id string, session_id string, object_set_id string, deleted_at timestamp, component string"
INFO = "dataset_id string, revision int, splits struct<train:string>"


def test_groups_and_broken_ranges(spark):
    rows = [
        ("d", 0, " OP1", "s1", None, None, "x"),
        ("d", 7, "op1 ", "s2", "unknown", None, "x"),  # linked to 0, outside the range
        ("e", 3, "op9", "S2", "", None, "x"),  # linked through 7; e has no range
        ("d", 1, "Unknown", None, " ", None, "x"),  # links nothing
        ("d", 8, "unknown", None, None, None, "x"),
        ("d", 2, "op5", "s5", None, None, "x"),
        ("d", 3, "op5", "s6", None, None, "x"),  # both inside
        ("d", 9, "op1", "s9", None, __import__("datetime").datetime(2024, 1, 1), "x"),  # deleted
        ("d", 4, "q1", None, None, None, "x"),
        ("d", 4, "q2", None, None, None, "x"),  # two rows of one episode tie q1 to q2
        ("d", 5, "q2", None, None, None, "x"),
        (None, 4, "q2", None, None, None, "x"),
    ]
    eps = spark.createDataFrame(rows, EPISODES)
    info = spark.createDataFrame([("d", 1, ("0:100",)), ("d", 2, (" :3, 3 : 5",)), ("e", 1, (None,))], INFO)
    got = {tuple(r) for r in broken_splits(eps, info).collect()}
    assert got == {("d", 0), ("d", 7), ("e", 3), ("d", 4), ("d", 5)}
    s = {(r["dataset_id"], r["episode_index"]): r for r in episode_splits(eps).collect()}
    assert s["d", 0]["split"] == s["d", 7]["split"] == s["e", 3]["split"]
    assert s["d", 0]["component"] == s["e", 3]["component"] and s["d", 4]["component"] == s["d", 5]["component"]
    assert s["d", 1]["component"] != s["d", 8]["component"] and ("d", 9) not in s


def test_shares(spark):
    rows = [("d", i, f"o{i}", None, None, None, None) for i in range(3000)]
    n = {r["split"]: r["count"] for r in episode_splits(spark.createDataFrame(rows, EPISODES)).groupBy("split").count().collect()}
    assert abs(n["train"] / 3000 - 0.8) < 0.03 and abs(n["test"] / 3000 - 0.1) < 0.03


def test_ranges(spark):
    cases = [("0:3,5:", 2, True), ("0:3,5:", 3, False), ("0:3,5:", 99, True), (":2", 1, True), ("", 1, False), ("x:y", 1, False), ("4", 4, True), (None, 4, None), (" 0 : 2 ", 1, True)]
    df = spark.createDataFrame(cases, "r string, i long, want boolean").withColumn("got", in_ranges(F.col("r"), F.col("i")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_empty(spark):
    eps, info = spark.createDataFrame([], EPISODES), spark.createDataFrame([], INFO)
    assert broken_splits(eps, info).count() == 0 and episode_splits(eps).count() == 0
