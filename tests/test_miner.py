"""The level-wise miner against a recursive one written from the definitions."""

import random

import pytest

from chronosift.operators import miner
from chronosift.operators.miner import IntervalMiner, MiningParams
from chronosift.plans import experiments


def relation(a, b):
    if a[0] > b[0]:
        a, b = b, a
    if a[0] < b[0]:
        return "b" if a[1] < b[0] else "m" if a[1] == b[0] else "o" if a[1] < b[1] else "fi" if a[1] == b[1] else "c"
    return "=" if a[1] == b[1] else "s" if a[1] < b[1] else "fi"


def naive(rows, minsup, maxgap, size):
    """Pattern states to (relations, support count): depth first over each client's first admissible occurrence."""
    clients = {}
    for c, s, a, b in rows:
        clients.setdefault(c, []).append((a, b, s))
    for seq in clients.values():
        seq.sort()
    least = int(minsup * len(clients))
    count = {}
    for seq in clients.values():
        for s in {x[2] for x in seq}:
            count[s] = count.get(s, 0) + 1
    frequent = {s for s, n in count.items() if n >= least}
    found = {}

    def grow(states, where):
        first = min(where)
        ivs = where[first][1]
        found[states] = ([relation(ivs[i], ivs[j]) for i in range(len(ivs)) for j in range(i + 1, len(ivs))], len(where))
        if len(states) == size:
            return
        nxt = {}
        for c, (pos, ivs) in where.items():
            done = set()
            for p in range(pos + 1, len(clients[c])):
                a, b, s = clients[c][p]
                if s in frequent and s not in done and (maxgap < 0 or all(a - x[1] <= maxgap for x in ivs)):
                    done.add(s)
                    nxt.setdefault(s, {})[c] = (p, [*ivs, (a, b)])
        for s, w in nxt.items():
            if len(w) >= least:
                grow((*states, s), w)

    for s in sorted(frequent):
        grow((s,), {c: next((p, [(a, b)]) for p, (a, b, x) in enumerate(seq) if x == s) for c, seq in clients.items() if any(x[2] == s for x in seq)})
    return found


def random_rows(seed, clients=9, length=12):
    rng = random.Random(seed)
    out = []
    for c in range(clients):
        for _ in range(length):
            a = rng.randrange(40)
            out.append((f"c{c}", rng.choice("ABCDE") + "_x", float(a), float(a + rng.randint(1, 9))))
    return sorted(set(out))


@pytest.mark.parametrize("seed,minsup,maxgap,size", [(1, 0.3, 5.0, 3), (2, 0.4, -1.0, 3), (3, 0.34, 2.0, 4)])
def test_patterns_equal_naive_miner(spark, seed, minsup, maxgap, size):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "client_id string, state string, start_time double, end_time double")
    got = {tuple(r.states): (list(r.relations), r.support_count) for r in miner.patterns(miner.sequences(df), MiningParams(minsup, 0.5, maxgap, size)).collect()}
    assert got == naive(rows, minsup, maxgap, size)


def test_rules_follow_from_the_patterns(spark):
    rows = random_rows(5)
    df = spark.createDataFrame(rows, "client_id string, state string, start_time double, end_time double")
    found, rules = IntervalMiner(0.3, 0.5, 6.0, 3).run(df)
    pats = naive(rows, 0.3, 6.0, 3)
    n, want = len({r[0] for r in rows}), {}
    tri = lambda rel, m, lo, hi: [r for (i, j), r in zip([(i, j) for i in range(m) for j in range(i + 1, m)], rel, strict=True) if lo <= i and j < hi]
    for states, (rel, c) in pats.items():
        for k in range(1, len(states)):
            pre, suf = states[:k], states[k:]
            if pre in pats and pats[pre][0] == tri(rel, len(states), 0, k):
                conf = (c / n) / (pats[pre][1] / n)
                if conf >= 0.5:
                    same = suf in pats and pats[suf][0] == tri(rel, len(states), k, len(states))
                    want[pre, states] = (conf, (c / n) / ((pats[pre][1] / n) * (pats[suf][1] / n)) if same else 0.0, c)
    got = {(tuple(r.antecedent_states), tuple(r.consequent_states)): (r.confidence, r.lift, r.support_count) for r in rules.collect()}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(ValueError):
        IntervalMiner().run()


def test_groups_are_mined_as_if_alone(spark):
    rows = [(*r, g) for g, seed in (("a", 1), ("b", 2)) for r in random_rows(seed, 6, 8)]
    df = spark.createDataFrame(rows, "client_id string, state string, start_time double, end_time double, ds string")
    p = MiningParams(0.5, 0.5, 4.0, 2)
    both = {(r.grp, tuple(r.states), r.support_count) for r in miner.patterns(miner.sequences(df, "ds"), p).collect()}
    alone = {(g, s, c) for g in "ab" for s, (_, c) in naive([r[:4] for r in rows if r[4] == g], 0.5, 4.0, 2).items()}
    assert both == alone


def test_relation_free_mining_equals_prefixspan(spark):
    from pyspark.ml.fpm import PrefixSpan

    rng = random.Random(3)
    seqs = [(f"c{c}", i, rng.choice("PQRS")) for c in range(8) for i in range(6)]
    df = spark.createDataFrame(seqs, "client_id string, i int, state string")
    found, rules = experiments.sequence_mining(df, ["i"], minsup=0.4, minconf=0.6, max_size=3)
    got = {(tuple(r.states), r.support_count) for r in found.collect()}
    lists = {}
    for c, _, s in seqs:
        lists.setdefault(c, []).append([s])
    model = PrefixSpan(minSupport=(int(0.4 * 8) - 0.5) / 8, maxPatternLength=3).findFrequentSequentialPatterns(spark.createDataFrame([(x,) for x in lists.values()], "sequence array<array<string>>"))
    want = {(tuple(s[0] for s in r.sequence), r.freq) for r in model.collect() if all(len(s) == 1 for s in r.sequence)}
    assert got == want
    assert all(0 <= r.confidence <= 1 for r in rules.collect())


def test_permutation_keeps_states_and_intervals(spark):
    rows = random_rows(7)
    df = spark.createDataFrame(rows, "client_id string, state string, start_time double, end_time double")
    got = [tuple(r) for r in experiments.permuted(df, ["client_id"]).select("client_id", "state", "start_time", "end_time").collect()]
    assert sorted(r[:2] for r in got) == sorted(r[:2] for r in rows)
    assert sorted((r[0], *r[2:]) for r in got) == sorted((r[0], *r[2:]) for r in rows)
    assert sorted(got) != rows


@pytest.mark.parametrize("maxgap", [0.5, 3.0])
def test_orders_that_starts_do_not_follow(spark, maxgap):
    """The first interval that keeps the gap may come after one that breaks it."""
    rows = [("c", "a", 0, 0.0, 1.0), ("c", "b", 1, 9.0, 9.5), ("c", "b", 2, 1.2, 2.0), ("c", "c", 3, 4.0, 5.0), ("d", "a", 0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "client_id string, state string, n int, start_time double, end_time double")
    found = miner.patterns(miner.sequences(df, None, ["n"]), MiningParams(0.1, 0.5, maxgap, 2))
    got = {tuple(r.states) for r in found.filter("size = 2").collect()}
    firsts = {("c", "a"): rows[0], ("c", "b"): rows[1], ("c", "c"): rows[3], ("d", "a"): rows[4]}
    assert got == {(f[1], r[1]) for f in firsts.values() for r in rows if r[0] == f[0] and r[2] > f[2] and r[3] - f[4] <= maxgap}


def test_a_long_client(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20000).select(F.lit("c").alias("client_id"), F.concat(F.lit("s_"), F.xxhash64("id") % 6).alias("state"), F.col("id").cast("double").alias("start_time"), (F.col("id") + 1.5).alias("end_time"))
    found = miner.patterns(miner.sequences(rows), MiningParams(0.5, 0.5, -1.0, 3)).groupBy("size").count().collect()
    assert {r["size"]: r["count"] for r in found} == {1: 11, 2: 121, 3: 1331}


@pytest.mark.parametrize(("block", "seed", "maxgap", "size"), [(1, 1, 5.0, 3), (2, 2, -1.0, 3), (5, 3, 2.0, 4), (3, 7, 9.0, 3)])
def test_blocks_change_nothing(spark, monkeypatch, block, seed, maxgap, size):
    """Sequences cut into blocks of a few places, the next block's first occurrence by pointer; places counted over ranges."""
    monkeypatch.setattr(miner, "BLOCK", block)
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "client_id string, state string, start_time double, end_time double")
    seq = miner.sequences(df, spread=True)
    got = {tuple(r.states): (list(r.relations), r.support_count) for r in miner.patterns(seq, MiningParams(0.3, 0.5, maxgap, size)).collect()}
    assert got == naive(rows, 0.3, maxgap, size)


def test_no_row_holds_a_long_client(spark):
    """A client of a million intervals: no row has more than a block of it, and patterns are found."""
    from pyspark.sql import functions as F

    rows = spark.range(1_000_000).select(F.lit("c").alias("client_id"), F.concat(F.lit("s_"), F.when(F.col("id") == 999_999, 9).otherwise(F.col("id") % 3)).alias("state"), F.col("id").cast("double").alias("start_time"), (F.col("id") + 1.5).alias("end_time"))
    params = MiningParams(0.5, 0.5, -1.0, 2)
    seq = miner.sequences(rows, spread=True)
    longest = miner._occurrences(seq, params).agg(F.max(F.size("at"))).first()[0]
    assert longest <= miner.BLOCK
    found = {tuple(r.states) for r in miner.patterns(seq, params).collect() if r.size == 2}
    assert found == {(f"s_{a}", f"s_{b}") for a in range(3) for b in (0, 1, 2, 9)}


@pytest.mark.parametrize(("minsup", "maxgap", "size"), [(0.3, 5.0, 3), (0.5, -1.0, 2), (0.05, 4.0, 2)])
def test_folds_equal_cells_mined_alone(spark, minsup, maxgap, size):
    """Each fold's cells by added counts, against mining the cell's rows themselves; groups of different sizes and states."""
    rows = [(f"{g}_{r[0]}", f"{r[1]}{'2' if g == 'c' else ''}", *r[2:], g) for g, seed, n in (("a", 1, 7), ("b", 2, 4), ("c", 3, 9)) for r in random_rows(seed, n, 8)]
    df = spark.createDataFrame(rows, "client_id string, state string, start_time double, end_time double, ds string")
    got = {}
    for r in miner.fold_patterns(miner.sequences(df, "ds"), MiningParams(minsup, 0.5, maxgap, size)).collect():
        got.setdefault(r.grp, {})[tuple(r.states)] = (list(r.relations), r.support_count)
    for g in "abc":
        for part, own in (("test", [r[:4] for r in rows if r[4] == g]), ("train", [r[:4] for r in rows if r[4] != g])):
            assert got[f"{g}|{part}"] == naive(own, minsup, maxgap, size)
