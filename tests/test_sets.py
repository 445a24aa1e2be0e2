"""Set algebra against Python sets."""

import random
from itertools import combinations

import pytest

from chronosift.operators import compare
from chronosift.operators import rules as rule_ops


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(4)
    return {f"d{i}": {f"r{j}" for j in range(30) if rng.random() < 0.6} for i in range(5)}


@pytest.fixture(scope="module")
def rules(spark, sets):
    rows = [(d, r, 0.5 + int(r[1:]) / 100 + int(d[1:]) / 50, 1.0 + int(d[1:]), 0.3) for d, s in sets.items() for r in s]
    return spark.createDataFrame(rows, "ds string, signature string, confidence double, lift double, support double").cache()


def test_universal_unique_majority_and_all_but_one(rules, sets):
    count = {r: [d for d in sets if r in sets[d]] for r in set().union(*sets.values())}
    assert {r.signature for r in compare.universal(rules).collect()} == {r for r, d in count.items() if len(d) == 5}
    assert {(r.signature, r.ds) for r in compare.unique_to_one(rules).collect()} == {(r, d[0]) for r, d in count.items() if len(d) == 1}
    assert {r.signature for r in compare.at_least(rules, 3).collect()} == {r for r, d in count.items() if len(d) >= 3}
    assert {(r.signature, r.missing) for r in compare.all_but_one(rules).collect()} == {(r, next(iter(set(sets) - set(d)))) for r, d in count.items() if len(d) == 4}
    assert compare.universal(rules, datasets=6).count() == 0


def test_matrices(rules, sets):
    assert {(r.left, r.right): r.n for r in compare.shared_matrix(rules).collect()} == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets}
    got = {(r.left, r.right): r.jaccard for r in compare.jaccard_matrix(rules).collect()}
    assert got == pytest.approx({(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets})
    for k in (2, 3):
        got = {(r.combo, r.target): r.n for r in compare.combination_matrix(rules, k).collect()}
        want = {("+".join(c), t): None if t in c else len(set.intersection(*(sets[x] for x in c), sets[t])) for c in combinations(sorted(sets), k) for t in sets}
        assert got == want
    assert {(r.left, r.right, r.signature) for r in compare.pairwise_common(rules).collect()} == {(a, b, s) for a, b in combinations(sorted(sets), 2) for s in sets[a] & sets[b]}


def test_sides_folds_and_details(rules, sets):
    r = compare.two_sides(rules, "ds", "d0", "d1").first()
    a, b = sets["d0"], sets["d1"]
    assert (r.n_union, r.n_shared, r.n_only_d0, r.n_only_d1) == (len(a | b), len(a & b), len(a - b), len(b - a))
    assert {x.signature for x in compare.confidence_shift(rules, "ds", "d0", "d4").collect() if x["shift"] == "up"} == sets["d0"] & sets["d4"]
    for r in compare.cross_validation(rules).collect():
        common = set.intersection(*(s for d, s in sets.items() if d != r.held_out))
        assert (r.n_common, r.n_validated) == (len(common), len(common & sets[r.held_out]))
        assert r.hit_rate == pytest.approx(100 * r.n_validated / r.n_common if r.n_common else 0)
    row = compare.detail_table(rules, "ds", ["d0", "d1"]).filter("d0_confidence IS NOT NULL AND d1_confidence IS NOT NULL").first()
    assert row.avg_confidence == pytest.approx((row.d0_confidence + row.d1_confidence) / 2, abs=1e-4)


def test_no_rules_at_all(spark):
    none = spark.createDataFrame([], "ds string, signature string, confidence double, lift double, support double")
    assert compare.universal(none).count() == 0 and compare.two_sides(none, "ds", "a", "b").first().jaccard == 1.0
    assert compare.jaccard_matrix(none).count() == 0 and compare.cross_validation(none).count() == 0


def test_top_rules_and_groups(spark):
    rows = [("g", f"s{i}", i / 10, 0.5, 1.0, 1) for i in range(10)] + [("h", "t", 0.9, 0.5, 1.0, 1)]
    df = spark.createDataFrame(rows, "grp string, signature string, confidence double, support double, lift double, support_count long")
    assert [r.signature for r in rule_ops.top_rules(df, 2).collect()] == ["s9", "t"]
    assert {(r.grp, r.signature) for r in rule_ops.top_in_group(df, "grp", "confidence", 1).collect()} == {("g", "s9"), ("h", "t")}
    assert rule_ops.details(df.union(df)).count() == 11


def test_permuted_universal_mines_once(spark, monkeypatch):
    """Original and shuffled data sets are mined in one job, with the counts of two; a row without data set has no part."""
    from chronosift.operators.miner import GROUP, MiningParams
    from chronosift.plans import experiments

    rows = [(f"d{c % 2}", f"c{c}", "xyzu"[(i * (1 + c % 3) + c) % 4], float(i), i + 1.0) for c in range(6) for i in range(5)] + [(None, "n", "x", 0.0, 1.0)]
    intervals = spark.createDataFrame(rows, "dataset string, client_id string, state string, start_time double, end_time double")
    params = MiningParams(0.3, 0.1, -1.0, 2)
    want = []
    for part in (intervals, experiments.permuted(intervals, ["dataset", "client_id"])):
        want.append(compare.universal(experiments.mined_rules(part, "dataset", params).withColumnRenamed(GROUP, "ds")).count())
    calls, mined = [], experiments.mined_rules
    monkeypatch.setattr(experiments, "mined_rules", lambda *a: (calls.append(a), mined(*a))[1])
    assert [tuple(r) for r in experiments.permuted_universal(intervals, params=params).collect()] == [tuple(want)] and sum(want) > 0
    assert len(calls) == 1
