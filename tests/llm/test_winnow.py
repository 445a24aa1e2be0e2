import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronosift.llm import queries, winnow
from tests.llm import helpers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), []
    for item, it in items:
        x = words(it)
        n = min(window, len(x))
        if not n:
            continue
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
        at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams]
        if at:
            found.append(str(item))
            for i in at:
                hit |= set(range(i, i + n))
    return len(w), sorted(hit), sorted(set(found))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(0, 3), max_size=16), max_size=4))
def test_match_equals_brute_force(doc, items):
    text = " ".join(f"w{i}" for i in doc)
    rows = [(str(k), " ".join(f"w{i}" for i in it)) for k, it in enumerate(items)]
    index = winnow.Index.of(rows)
    start, end, owners = index.match(winnow.hashes_of(pa.array([text]))[0])
    hit = [i for a, b in zip(start, end, strict=True) for i in range(a, b)]
    n, want, found = brute(text, rows)
    assert (n, hit, sorted(index.items[o] for o in owners)) == (len(doc), want, found)


def test_every_shared_span_keeps_a_common_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = rng.integers(0, 5, 10).astype(np.uint64)
        sides = [np.concatenate([rng.integers(0, 5, rng.integers(0, 9)).astype(np.uint64), shared, rng.integers(0, 5, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(2)]
        a, b = (set(winnow.grams(h, 5)[winnow.winnow(winnow.grams(h, 5), 6)].tolist()) for h in sides)
        assert a & b


def fixtures(spark):
    bench = [
        (0, helpers.sentence(1, 14)),
        (10, helpers.sentence(6, 12)),
        (2, "no identifier HERE"),
        (3, None),
        (4, "... "),
        (2, "日本語"),
        (7, helpers.sentence(77, 30)),
    ]
    docs = helpers.clashing(spark)
    return docs, spark.createDataFrame(bench, "item_id long, text string"), bench


@pytest.mark.parametrize("limit", [winnow.LIMIT_WORDS, 0])
def test_awkward_rows_on_both_ways(spark, limit):
    docs, bench, items = fixtures(spark)
    got = sorted((str(r.doc_id), r.n_words, [i for s in r.spans for i in range(s.start, s.end)], r["items"]) for r in winnow.find(docs, bench, limit_words=limit).collect())
    want = sorted((str(r[0]), *brute(r[1], items)) for r in helpers.awkward_rows())
    assert got == want
    assert winnow.find(helpers.empty(spark), bench, limit_words=limit).count() == 0
    assert all(r.spans == [] and r["items"] == [] for r in winnow.find(docs, bench.limit(0), limit_words=limit).collect())


def test_query_on_data(spark):
    from tests.llm.helpers import SF

    got = {r.doc_id: r for r in queries.op7_decontaminate(spark, SF).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs) and sum(r.contaminated for r in got.values()) > 0
    for d in docs:
        n, hit, found = brute(d.text, items)
        g = got[d.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, len(hit), len(found), bool(hit))
        assert g.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


@pytest.mark.parametrize("limit", [winnow.LIMIT_WORDS, 0])
def test_items_without_identifier_hit(spark, limit):
    texts = [helpers.sentence(i, 30) for i in range(201, 206)]
    bench = [(None, texts[0]), (None, texts[1]), (5, texts[1]), (None, "two words"), (None, None)]
    docs = [(1, "x " + texts[0] + " y"), (2, texts[1]), (3, texts[2]), (4, "in two words"), (None, texts[3])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: ([i for s in r.spans for i in range(s.start, s.end)], r["items"]) for r in winnow.find(d, b, limit_words=limit).collect()}
    assert got == {i: (brute(t, bench)[1], ["5"] if i == 2 else []) for i, t in docs}
    assert len(got[1][0]) == 30 and len(got[4][0]) == 2
    assert sorted(str(r.doc_id) for r in winnow.clean(d, b, limit_words=limit).collect()) == ["3", "None"]


def test_a_passage_in_all_documents_and_items(spark, monkeypatch):
    """The fingerprints of one passage are everyone's: both ways agree, and hot hashes are dealt out."""
    monkeypatch.setattr(winnow, "HOT", 20)
    monkeypatch.setattr(winnow, "SALTS", 4)
    passage = helpers.sentence(77, 30)
    docs = [(i, f"{helpers.sentence(i, 12)} {passage} {helpers.sentence(i + 500, 15)}") for i in range(60)] + [(99, helpers.sentence(901, 50)), (100, None)]
    items = [(i, f"{helpers.sentence(i + 1000, 5)} {passage}") for i in range(25)] + [(50, "four words of 5"), (51, helpers.sentence(3, 12))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    ways = [sorted((r.doc_id, r.n_words, [tuple(x) for x in r.spans], r["items"]) for r in winnow.find(d, b, limit_words=n).collect()) for n in (0, 10**6)]
    assert ways[0] == ways[1]
    assert all(len(r[3]) >= 25 for r in ways[0] if r[0] < 60) and ways[0][-1][2] == []
