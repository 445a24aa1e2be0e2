import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from chronosift.llm import partenum, queries, winnow
from tests.llm import helpers
from tests.llm.test_fair_mix import brute_targets, size
from tests.llm.test_partenum import brute as brute_components
from tests.llm.test_rule_ledger import brute as brute_measures
from tests.llm.test_winnow import brute as brute_hits


def brute_quality(text):
    n, chars, symbols, _, repeated = brute_measures(text)
    letters = sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in text or "")
    upper = sum("A" <= c <= "Z" for c in text or "")
    marks = sum(c in "!?" for c in text or "")
    return not (n < 10 or 100 * repeated > 20 * n or 10 * symbols > 2 * n or 2 * letters < chars or (10 * upper > 6 * letters > 0) or 10 * marks > 5 * n)


def key(r):
    return (r.doc_id, r.text, r.lang, r.source, r.n_chars)


def through(spark, docs, sf_dir):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def test_stages_equal_brute_force(spark):
    sf = helpers.SF
    docs, good, single, clean, mix, shards = through(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    for stage in (good, single, clean, mix):
        assert stage.columns == docs.columns
    want = sorted(map(key, (r for r in docs.collect() if brute_quality(r.text))))
    assert sorted(map(key, good.collect())) == want and len(want) < docs.count()
    heads = {int(d) for d, _, c in brute_components([(r[0], r[1]) for r in want]) if int(d) == c}
    want = [r for r in want if r[0] in heads]
    assert sorted(map(key, single.collect())) == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [r for r in want if not brute_hits(r[1], items)[1]]
    assert sorted(map(key, clean.collect())) == want
    counts = Counter(map(key, mix.collect()))
    assert set(counts) <= set(want) and max(counts.values()) <= 2
    per, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in want:
        per[r[3]] += size(r[1])
        taken[r[3]] += size(r[1]) * counts[r]
        largest[r[3]] = max(largest[r[3]], size(r[1]))
    for s, target in brute_targets(dict(per)).items():
        assert abs(taken[s] - target) <= largest[s]
    tok, start, expected = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for d, text in sorted((k[0], k[1]) for k, n in counts.items() for _ in range(n)):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in shards.collect()), key=lambda r: r[1])
    assert got == expected
    run = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run) == sorted(expected)


def test_awkward_tables(spark):
    for docs in (helpers.clashing(spark), helpers.empty(spark)):
        stages = through(spark, docs, helpers.SF)
        assert all(s.columns == docs.columns for s in stages[1:-1])
        kept = {r.doc_id for r in stages[2].collect()}
        assert kept <= {1, 5, 6, -7, None}
        assert len(stages[2].collect()) == len(kept)


def test_rows_are_known_by_identifier_and_text(spark):
    """Rows without identifier, and texts under one identifier, go or stay each by itself."""
    a, b, c, d, e = (helpers.sentence(i, 40) for i in (101, 102, 103, 104, 105))
    rows = [(1, a), (None, a), (None, b), (5, a + " more"), (5, c), (None, d), (None, d), (7, e)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], helpers.SCHEMA)
    kept = partenum.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (None, b), (5, c), (None, d), (7, e)])
    bench = spark.createDataFrame([(1, c), (2, b)], "item_id long, text string")
    for limit in (winnow.LIMIT_WORDS, 0):
        clean = winnow.clean(docs, bench, limit_words=limit)
        assert clean.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter([(1, a), (None, a), (5, a + " more"), (None, d), (None, d), (7, e)])
