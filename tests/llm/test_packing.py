from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from trajspark.llm.packing import best_fit, pack, pack_report, placements


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.lists(st.integers(40, 90), min_size=1, max_size=3))
def test_plans_hold_everything_once(counts, capacities):
    groups = best_fit(dict(counts), capacities)
    held = Counter()
    for g in groups:
        used = sum(s * k for s, k in g.inside)
        assert used <= g.capacity and used + g.room == g.capacity and g.capacity in capacities
        assert g.capacity == min(c for c in capacities if c >= used)
        for s, k in g.inside:
            held[s] += k * g.count
    assert held == Counter(counts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 12), min_size=1, max_size=8))
def test_as_good_as_best_fit_decreasing_one_by_one(counts):
    bins = []
    for s in sorted(counts, reverse=True):
        for _ in range(counts[s]):
            fit = [b for b in bins if b[0] >= s]
            if fit:
                min(fit)[0] -= s
            else:
                bins.append([30 - s])
    assert sum(g.count for g in best_fit(dict(counts), [30])) == len(bins)


def test_placements_cover_the_ranks():
    groups = best_fit({7: 10, 3: 25, 2: 4}, [20])
    for s, (first, base, each, _) in placements(groups).items():
        assert first[0] == 0 and (first[1:] > first[:-1]).all()


def test_documents_are_cut_only_where_they_must_be(spark):
    rows = [(1, 0), (2, 5), (3, 25), (4, 10), (5, 5), (6, None), (7, 20), (8, 3), (9, 3)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = pack(df, [(1, [10]), (2, [30])]).collect()
    for p, c in ((1, 10), (2, 30)):
        mine = [r for r in got if r["pack_id"] == p]
        assert {r["doc_id"] for r in mine} == {1, 2, 3, 4, 5, 7, 8, 9}
        by = Counter()
        for r in mine:
            by[r["container"]] += r["n_tokens"]
        assert max(by.values()) <= c
        for d, n in rows:
            pieces = sorted(r["n_tokens"] for r in mine if r["doc_id"] == d)
            if n is not None:
                assert sum(pieces) == n and len(pieces) == max(1, -(-n // c))
        assert len(by) == -(-sum(n or 0 for _, n in rows) // c)
    rep = {r["pack_id"]: r for r in pack_report(pack(df, [(1, [10])])).collect()}
    assert rep[1]["overfull"] <= 0
    assert pack(spark.createDataFrame([], df.schema), [(1, [10])]).count() == 0
    assert pack(spark.createDataFrame([(1, 0)], df.schema), [(1, [10])]).collect()[0]["container"] == 0


def test_several_capacities_are_used_jointly():
    groups = best_fit({100: 3, 30: 1}, [32, 64, 128])
    assert sorted(g.capacity for g in groups for _ in range(g.count)) == [32, 128, 128, 128]
