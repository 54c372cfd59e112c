import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from trajspark.llm.mixing import fit_source, knapsack, mix_report, mix_selection, robot_sources


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(0, 3), max_size=4), st.integers(0, 40))
def test_knapsack_is_exact(counts, budget):
    taken = knapsack(list(counts.items()), budget)
    assert all(0 <= k <= counts[s] for s, k in taken.items())
    best = max(t for c in itertools.product(*[range(n + 1) for n in counts.values()]) if (t := sum(s * k for s, k in zip(counts, c))) <= budget)
    assert sum(s * k for s, k in taken.items()) == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 20), min_size=1, max_size=6), st.floats(0, 5000), st.integers(0, 4))
def test_fit_respects_repeats_and_budget(counts, budget, most):
    passes, once = fit_source(list(counts.items()), budget, most)
    total = sum(s * (c * passes + once.get(s, 0)) for s, c in counts.items())
    assert passes + bool(once) <= most or not once
    assert all(k <= counts[s] for s, k in once.items())
    supply = sum(s * c for s, c in counts.items())
    assert total <= budget or total == most * supply <= budget + 1e-9


INFO = "dataset_id string, revision int, robot_type string, total_frames long"
TARGETS = "mix_id int, robot_type string, target_share double, max_repeats int"


def test_report_and_selection(spark):
    info = [("a", 1, "X-bot", 10), ("a", 2, None, 0), ("a", 2, None, 0), ("b", 1, "x bot", 30), ("c", 5, "y", 60), ("d", 1, None, 5), ("e", 1, "z", None), (None, 1, "x_bot", 7)]
    targets = [(1, "X_Bot", 0.5, 2), (1, "y", 0.5, 1), (1, "none", 0.0, 1), (2, "x_bot", 0.9, 1), (2, "y", 0.1, 1), (3, "none", 1.0, 9), (4, None, 1.0, 1)]
    i, t = spark.createDataFrame(info, INFO), spark.createDataFrame(targets, TARGETS)
    src = robot_sources(i)
    assert {tuple(r) for r in src.collect()} == {("a", "x_bot", 10), ("b", "x_bot", 30), ("c", "y", 60)}
    rep = {(r["mix_id"], r["robot_type"]): r for r in mix_report(src, t).collect()}
    assert rep[1, "X_Bot"]["selected"] == 50 and rep[1, "X_Bot"]["reachable"]
    assert rep[1, "y"]["selected"] == 0 and rep[1, "y"]["reachable"]  # 50 frames, but its only data set has 60
    assert not rep[2, "x_bot"]["reachable"] and rep[2, "x_bot"]["selected"] == 40
    assert rep[3, "none"]["reachable"] and rep[3, "none"]["actual_share"] is None
    sel = {(r["mix_id"], r["dataset_id"]): r["repeats"] for r in mix_selection(src, t, "dataset_id").collect()}
    assert sel[1, "a"] * 10 + sel[1, "b"] * 30 == 50 and sel[2, "a"] == sel[2, "b"] == 1
    again = {(r["mix_id"], r["dataset_id"]): r["repeats"] for r in mix_selection(src.repartition(3), t, "dataset_id").collect()}
    assert again == sel


def test_empty(spark):
    i, t = spark.createDataFrame([], INFO), spark.createDataFrame([], TARGETS)
    assert mix_report(robot_sources(i), t).count() == 0
    assert mix_selection(robot_sources(i), t, "dataset_id").count() == 0


def test_sizes_beyond_the_items_close_the_rest():
    sizes, budget = [(s, 1) for s in range(1, 2001)], sum(range(1489, 2001)) + 1000
    taken = knapsack(sizes, budget)
    assert sum(s * k for s, k in taken.items()) == budget and all(0 < k <= 1 for k in taken.values())
