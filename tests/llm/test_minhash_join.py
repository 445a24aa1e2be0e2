import random
from dataclasses import replace

import numpy as np

from chronosift.llm import minhash_join, partenum, queries
from chronosift.llm.textops import splitmix
from tests.llm import helpers


def brute_set(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\r\x0b\x0c":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    head = list(range(len(rows)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    head[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted((str(d), len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in minhash_join.components(df).collect())


def test_signatures_within_the_distance_share_a_key():
    """Whichever symbols differ: at random, or as evenly as the chunks allow."""
    rng = random.Random(1)
    base = np.array([splitmix(i) & 0xFFFF for i in range(minhash_join.SYMBOLS)], dtype=np.uint16)
    for trial in range(300):
        other = base.copy()
        if trial % 2:
            at = rng.sample(range(minhash_join.SYMBOLS), minhash_join.DISTANCE)
        else:
            per = [2] * minhash_join.CHUNKS
            per[rng.randrange(minhash_join.CHUNKS)] = 1
            at = [c * minhash_join.WIDTH + i for c, n in enumerate(per) for i in rng.sample(range(minhash_join.WIDTH), n)]
        assert len(at) == minhash_join.DISTANCE
        other[at] ^= np.uint16(1)
        x, y = (set(minhash_join.keys(v[None, :]).ravel().tolist()) for v in (base, other))
        assert x & y
        assert minhash_join.near([base.tobytes()], [other.tobytes()]).all()


def test_few_pairs_are_missed():
    assert minhash_join.missed(0.85) < 1e-6
    assert minhash_join.missed(0.9) < 1e-9


def test_minhashes_estimate_similarity():
    rng = np.random.default_rng(3)
    differ = []
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        b = a.copy()
        b[:81] = rng.integers(0, 1 << 63, 81, dtype=np.uint64)
        x, y = minhash_join.minhashes([np.sort(a), np.sort(b)])
        differ.append(int((x != y).sum()))
    expected = minhash_join.SYMBOLS * (1 - 919 / 1081)
    assert abs(np.mean(differ) - expected) < 1 and np.std(differ) < 4


def test_long_sets_are_cut_without_effect(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (7, 5000, 1, 300)]
    whole = minhash_join.minhashes(sets)
    monkeypatch.setattr(minhash_join, "PIECE", 97)
    assert (minhash_join.minhashes(sets) == whole).all()


def near_copies():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(500)}"
    rows, n = [], 0
    for _ in range(30):
        text = [word() for _ in range(rng.choice([1, 2, 4, 8, 9, 14, 30, 60, 150]))]
        for _ in range(rng.choice([1, 3, 12])):
            t = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, len(t) // 25]) if len(t) > 2 else 0):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [word()], [t[i].upper()]])
            rows.append((n * 7 % 1009, " ".join(t)))
            n += 1
    return rows + rows[:5]


def test_near_copies_equal_brute_force(spark, monkeypatch):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df) == brute(rows)
    # Hot buckets and crowded ones, sifted and in slices.
    for name, n in (("GATHER", 100), ("LOCAL", 2), ("LIGHT", 1), ("HOT", 3), ("PARTNERS", 2), ("PAIRS_A_ROW", 0)):
        monkeypatch.setattr(partenum, name, n)
    monkeypatch.setattr(minhash_join, "METHOD", replace(minhash_join.METHOD, at_once=40))
    assert found(df) == brute(rows)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in helpers.awkward_rows()]
    rows += [(None, "one two three four five six seven eight nine ten"), (70, "one two three four five six seven eight nine ten"), (None, "alone without identifier")]
    df = helpers.clashing(spark).unionByName(spark.createDataFrame(rows[-3:], "doc_id long, text string"), allowMissingColumns=True)
    assert found(df) == brute(rows)
    assert found(helpers.empty(spark)) == []


def test_deduplicated_keeps_the_smallest(spark):
    text = helpers.sentence(3, 200)
    near = text.replace(text.split()[100], "changed", 1)
    rows = [(5, near, "x"), (3, text, "y"), (9, "other text here", "z")]
    kept = minhash_join.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, k string")).collect()
    assert sorted((r.doc_id, r.k) for r in kept) == [(3, "y"), (9, "z")]


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{helpers.SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_minhash_dedup(spark, helpers.SF).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_sql_equals_brute_force():
    import duckdb

    rows = near_copies() + [(None, "a b c d e f g h"), (2001, "a b c d e f g h"), (2002, None), (2003, " "), (2004, "x"), (2005, "X")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = con.execute(minhash_join.oracle()).fetchall()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == brute(rows)
