import zlib

import numpy as np

from chronosift.llm import lang_kernel, queries
from tests.llm import helpers


def test_held_out_accuracy_on_data(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_language(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        d = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))
        if r.held_out and r.lang_pred != "und":
            total += 1
            right += r.lang_pred == d.lang
    assert total > 100 and right / total >= 0.97


def test_kernel_equals_brute_force():
    rows = [("abc dé abc".encode(), "x"), ("xyz ÉÉ".encode(), "y"), ("abx".encode(), "x"), ("zzz 123".encode(), "y")]
    m = lang_kernel.fit(rows, ridge=1e-3)

    def grams(t):
        s = [c.lower() if c.isalpha() else "" for c in t.decode()]
        return {tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    got = m.kernel([m.present(t) for t, _ in rows])
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows):
            want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
            assert abs(got[i, j] - want) < 1e-5
    # The ridge solution is where the gradient of the penalised squares is nought.
    y = np.array([[1.0 if lang == c else -1.0 for c in m.langs] for _, lang in rows])
    grad = got.T @ (got @ m.weights - y) + 1e-3 * len(rows) * got @ m.weights
    assert np.abs(grad).max() < 1e-3
    assert lang_kernel.fit([(b"123", "x")]) is None


def test_awkward_rows(spark):
    docs = helpers.clashing(spark)
    model = lang_kernel.learn(docs)
    rows = lang_kernel.predict(docs, model, ["doc_id"]).collect()
    assert len(rows) == len(helpers.awkward_rows())
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert lang_kernel.learn(helpers.empty(spark)) is None
    assert all(r.lang_pred == "und" for r in lang_kernel.predict(docs, None, ["doc_id"]).collect())
    assert lang_kernel.predict(helpers.empty(spark), model, ["doc_id"]).count() == 0


def test_lookup_with_collisions():
    rng = np.random.default_rng(2)
    known = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    look = lang_kernel.Lookup(known)
    code = np.concatenate([known[::7], rng.integers(0, 1 << 62, 3000).astype(np.uint64)])
    assert look(code).tolist() == np.flatnonzero(np.isin(known, code)).tolist()
    few = lang_kernel.Lookup(known)
    few.rest = np.arange(len(known))
    few.tables = [np.zeros_like(t) for t in few.tables]
    assert few(code).tolist() == np.flatnonzero(np.isin(known, code)).tolist()


def test_scripts_with_many_letters():
    """Languages of large alphabets, with short texts, keep all their letters apart."""
    rng = np.random.default_rng(4)
    letters = {"zh": range(0x4E00, 0x5E00), "ja": [*range(0x3041, 0x3090), *range(0x4E00, 0x5E00, 3)], "ko": range(0xAC00, 0xBC00), "th": range(0x0E01, 0x0E2F), "am": range(0x1200, 0x1250), "ka": range(0x10D0, 0x10F0)}
    weights = {k: rng.zipf(1.3, len(v)).astype(float) for k, v in letters.items()}

    def text(lang):
        w = weights[lang] / weights[lang].sum()
        return "".join(chr(c) for c in rng.choice(np.array(list(letters[lang])), 80, p=w)).encode()

    rows = [(text(lang), lang) for lang in letters for _ in range(120)]
    model = lang_kernel.fit(rows)
    tests = [(text(lang), lang) for lang in letters for _ in range(60)]
    best = model.scores([model.present(t) for t, _ in tests]).argmax(axis=1)
    assert np.mean([model.langs[b] == lang for b, (_, lang) in zip(best, tests, strict=True)]) > 0.97
