import random

import numpy as np
import pyarrow as pa
import pytest

from chronosift.llm import components, partenum, queries, textops
from chronosift.llm.textops import splitmix
from tests.llm import helpers


def brute_set(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\r\x0b\x0c":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Rows of (doc_id, n, component) in the order of the table."""
    sets = [brute_set(t) for _, t in rows]
    head = list(range(len(rows)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    head[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted((str(d), len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("size", [3, 4, 6, 7, 9, 12, 17, 20, 24, 25, 40, 60, 100, 250])
def test_sets_at_the_threshold_share_a_signature(size):
    rng = random.Random(size)
    for trial in range(150):
        other = rng.randint(size, partenum.largest_partner(size))
        both = -(-3 * (size + other) // 7)
        ids = rng.sample(range(10**6), size + other - both)
        h = lambda x: np.sort(np.array([splitmix(i) for i in x], dtype=np.uint64))
        a, b = h(ids[:size]), h(ids[:both] + ids[size:])
        assert len(a) == size and len(b) == other
        common = h(ids[:both] if trial % 3 == 0 else ids[: both // 2] if trial % 3 == 1 else [])
        third = h(ids[:3])
        sig, place = partenum.signatures_of([a, third, b], common)
        x, y = (set(sig[place == i].tolist()) for i in (0, 2))
        assert x & y
        alone, _ = partenum.signatures_of([b], common)
        assert set(alone.tolist()) == y


def test_bands_enumerate_enough():
    """More signatures than the possible differences can touch, whichever they are, and no more than there are."""
    for band in partenum.BANDS[:12]:
        most = partenum.differences(band.high)
        assert band.needed(most) <= band.given
        if band.parts < 12:
            from itertools import combinations

            groups = [range(i * band.second, (i + 1) * band.second) for i in range(band.first)]
            subsets = [set(c) for g in groups for c in combinations(g, band.subset)]
            for k in range(min(most, 4) + 1):
                touched = max(sum(1 for s in subsets if s & set(hit)) for hit in combinations(range(band.parts), k))
                assert band.needed(k) == touched + 1


def near_copies():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(500)}"
    rows, n = [], 0
    passage = [word() for _ in range(30)]
    for base in range(25):
        text = [word() for _ in range(rng.choice([2, 5, 7, 8, 12, 20, 45, 90, 200]))]
        if base % 3 == 0:
            text += passage
        for copy in range(rng.choice([1, 2, 9])):
            t = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3, len(t) // 20])):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [word()], [t[i].upper()]])
            rows.append((n * 7 % 1009, " ".join(t)))
            n += 1
    return rows + rows[:5]


def test_near_copies_equal_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in partenum.components(df).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("pairs_a_row", [0, 1000])
def test_sifting_equals_brute_force(spark, monkeypatch, pairs_a_row):
    """With all buckets sifted, pivots preferred as long as they help and then slices, or all at once; sides joined by shuffles, buckets spread and partners in parts."""
    monkeypatch.setattr(partenum, "PAIRS_A_ROW", pairs_a_row)
    monkeypatch.setattr(partenum, "PAIRS_AT_ONCE", 40)
    monkeypatch.setattr(partenum, "GATHER", 100)
    monkeypatch.setattr(partenum, "LOCAL", 2)
    monkeypatch.setattr(partenum, "PARTNERS", 1)
    monkeypatch.setattr(components, "ONE_TASK", 0)
    monkeypatch.setattr(partenum, "LIGHT", 1)
    monkeypatch.setattr(partenum, "BROADCAST_ROWS", 0)
    rows = near_copies()[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in partenum.components(df).collect())
    assert got == brute(rows)


def test_awkward_rows(spark):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in partenum.components(helpers.clashing(spark)).collect())
    assert got == brute([(r[0], r[1]) for r in helpers.awkward_rows()])
    assert partenum.components(helpers.empty(spark)).count() == 0


def test_query_on_data(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{helpers.SF}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in queries.op10_jaccard_join(spark, helpers.SF).collect())
    assert got == brute(rows)


def test_links_through_rows_without_identifier(spark):
    """a ~ x ~ b, with x in such rows alone and a not similar to b; their copies go in favour of rows with an identifier."""
    words = helpers.sentence(301, 62).split()
    a, x, b = (" ".join(words[i : i + 50]) for i in (0, 6, 12))
    lone = helpers.sentence(302, 40)
    rows = [(3, a), (None, x), (None, x.upper()), (9, b), (None, x), (None, lone), (None, lone + " more"), (4, helpers.sentence(303, 40))]
    want = brute(rows[:5] + rows[7:]) + [("None", 36, None), ("None", 37, None)]
    assert ("9", 46, 3) in want and brute([r for r in rows if r[0] is not None])[-1] == ("9", 46, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in partenum.components(docs).collect()), key=str)
    assert got == sorted(want, key=str)
    kept = sorted(((r.doc_id, r.text) for r in partenum.one_of_each(docs).collect()), key=str)
    assert kept == sorted([rows[0], rows[5], rows[6], rows[7]], key=str)


def test_words_of_a_batch(monkeypatch):
    """Texts of any length, cut into pieces anywhere, give the same hashes; equal words equal ones."""
    rng, known = random.Random(0), {}
    for _ in range(150):
        texts = [rng.choice([None, "", "".join(rng.choice("abAB \n\t\x0b\x1cé\U0001f600") for _ in range(rng.randrange(60)))]) for _ in range(rng.randrange(6))]
        for piece in (3, 7, 1 << 18):
            monkeypatch.setattr(textops, "PIECE", piece)
            h, at = textops.word_hashes(pa.array(texts, type=pa.string()))
            words = [(t or "").encode().lower().split() for t in texts]
            assert np.diff(at).tolist() == [len(w) for w in words]
            for w, x in zip((w for ws in words for w in ws), h.tolist(), strict=True):
                assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_texts_of_megabytes(spark):
    a = helpers.sentence(31, 250_000)
    rows = [(1, a), (2, a + " more"), (3, "x" * 3_000_000), (4, "x" * 3_000_000 + " y"), (5, a[: len(a) // 2])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (len(brute_set(t)), {2: 1}.get(d, d)) for d, t in rows}


def test_lossy_counts_hold_every_frequent_shingle():
    rng = np.random.default_rng(3)
    counts, true, n = partenum.Counts(1000), {}, 0
    for i in range(400):
        s = np.unique(np.concatenate([rng.integers(0, 40, 10), rng.integers(100, 10**9, 60), np.arange(5000, 9000) if i == 7 else []]).astype(np.uint64))
        counts.add(s)
        n += len(s)
        for x in s.tolist():
            true[x] = true.get(x, 0) + 1
    keys, upper = counts.often(1)
    got = dict(zip(keys.tolist(), upper.tolist(), strict=True))
    assert keys.tolist() == sorted(got) and len(got) < 2000
    slack = n / 1000
    assert all(x in got for x, c in true.items() if c > slack)
    assert all(true[x] <= c <= true[x] + slack for x, c in got.items())


def test_shingles_are_counted_over_all_documents(spark):
    line = "one passage that a great many documents share"
    rows = [(i, f"{line} w{i} x{i} y{i}") for i in range(1500)] + [(None, None), (5000, ""), (5001, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = partenum.scan(df, "doc_id", "text")
    assert found.filter("shingle IS NULL").count() == len(rows)
    common = partenum.common_shingles(found)
    assert len(common) == 4 and (np.diff(common.astype(object)) > 0).all()
    assert set(common.tolist()) <= set(partenum.shingle_sets(pa.array([line]))[0].tolist())
