import random

from hypothesis import given, settings
from hypothesis import strategies as st

from chronosift.llm import queries, wordpiece
from tests.llm import helpers


def greedy(vocab, word):
    s, n = (*word, wordpiece.END), 0
    while s:
        cut = next((k for k in range(len(s), 0, -1) if s[:k] in vocab), 0)
        if not cut:
            return 0
        s, n = s[cut:], n + 1
        if s == (wordpiece.END,) and s not in vocab:
            break
    return n


TOKENS = st.lists(st.tuples(st.lists(st.sampled_from([97, 98, 99]), min_size=1, max_size=5), st.booleans()), min_size=1, max_size=14)


@settings(max_examples=400, deadline=None)
@given(TOKENS, st.lists(st.lists(st.sampled_from([97, 98, 99]), min_size=1, max_size=14), max_size=8))
def test_counts_equal_greedy_matching(tokens, words):
    vocab = {(*t, wordpiece.END) if end else tuple(t) for t, end in tokens}
    auto = wordpiece.Automaton(sorted(vocab))
    for w in words:
        assert auto.count(bytes(w)) == greedy(vocab, w)


def test_whole_vocabulary(spark):
    vocab = set(wordpiece.load_vocabulary(queries.tokenizer_path()))
    auto = wordpiece.Automaton(sorted(vocab))
    rng, tokens = random.Random(2), sorted(vocab)
    for _ in range(500):
        word = bytes(c for t in rng.sample(tokens, 3) for c in t if c != wordpiece.END)
        assert auto.count(word) == greedy(vocab, word) > 0
    rows = {r.doc_id: r for r in queries.op8_token_counts(spark, helpers.SF).collect()}
    for d in spark.read.parquet(f"{helpers.SF}/documents.parquet").limit(30).collect():
        found = wordpiece.WORD.findall((d.text or "").encode().lower())
        r = rows[d.doc_id]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(found), sum(greedy(vocab, w) for w in found), 0)


def test_awkward_rows(spark):
    path = queries.tokenizer_path()
    rows = wordpiece.counts(helpers.clashing(spark), path, ["doc_id"]).collect()
    assert len(rows) == len(helpers.awkward_rows()) and all(r.n_tokens == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert wordpiece.counts(helpers.empty(spark), path, ["doc_id"]).count() == 0
