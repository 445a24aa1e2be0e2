import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chronosift.llm import queries, secret_grammar
from tests.llm import helpers

PATTERNS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def brute(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(group), k, m.end(group), kind))
    return [(a, e, kind) for a, _, e, kind in sorted(found)]


PIECES = st.sampled_from(["password", "PassWD", "token", "api_key", "APIKEY", "ſecret", "secret", " ", "=", ":", '"', "'", "é", "AKIA", "AB12", "0123456789abcdef", "deadbeef", "G", "z", ".", "-", "🎉", "\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_base_spans_equal_brute_force(pieces):
    text = "".join(pieces)
    found = secret_grammar.Scanned(pa.array([text, None, text]))
    place = found.points(2)
    assert [(place(a), place(b), secret_grammar.KINDS[k]) for a, b, k, _ in found.base[2]] == brute(text) and found.base[1] == []
    at, raw = int(found.cuts[2]), text.encode()
    whole = [(at + a, at + b) for _, b, _, a in found.base[2]]
    for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True):
        if a >= at:
            run = raw[a - at : b - at].decode()
            assert set(run) <= set(secret_grammar.CLASS_OF) and len(run) >= 6 and not any(s < b and a < e for s, e in whole)


def test_automaton_is_a_distribution_and_prefers_its_format():
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(400)]
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(400)]
    a, b = secret_grammar.infer(hexes), secret_grammar.infer(words)
    for m in (a, b):
        for row in m.log_p:
            assert abs(sum(map(math.exp, row)) - 1) < 1e-9
        assert len(m.log_p) < 60
    fresh = "".join(rng.choice("0123456789abcdef") for _ in range(20))
    assert a.score(fresh) - b.score(fresh) > secret_grammar.GAIN
    assert a.score(words[0]) < b.score(words[0])
    assert a.score("é") == -math.inf
    tokens = [*hexes[:5], "a.b=C", "", words[0] * 9, "Zz/+_-"]
    data = np.frombuffer("".join(tokens).encode(), dtype=np.uint8)
    length = np.array([len(t) for t in tokens])
    got = a.scores(secret_grammar.CLASS_BYTES[data], np.cumsum(length) - length, length)
    assert np.allclose(got, [a.score(t) for t in tokens])


def test_query_on_data(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op4_secrets(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in rows.values()) > 10
    for d in docs:
        want, r = brute(d.text), rows[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for *_, k in want) for kind in secret_grammar.KINDS[:3])
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert {x for x in text.split(",") if x} <= set(r.spans.split(","))


def test_grammar_adds_unlabelled_credentials(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"it is password={key(18)} {helpers.sentence(i, 8)}") for i in range(300)]
    rows += [(1000 + i, f"bare {key(20)} here and 4{rng.randrange(10**15):015d} then") for i in range(20)]
    rows += [(2000 + i, f"card {rng.randrange(10**15, 10**16)} abcdefghijklmnopqrs{i}xyz") for i in range(200)]
    got = {r.doc_id: r for r in secret_grammar.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(any(s.kind == "grammar" for s in got[1000 + i].spans) for i in range(20)) >= 17
    assert sum(any(s.kind == "grammar" for s in got[2000 + i].spans) for i in range(200)) <= 4
    assert all([s.kind for s in got[i].spans] == ["assign"] for i in range(300))


def test_awkward_rows(spark):
    rows = secret_grammar.find(helpers.clashing(spark)).collect()
    assert len(rows) == len(helpers.awkward_rows()) and all(r.spans == [] for r in rows if r.doc_id in (2, 3, 4))
    assert secret_grammar.find(helpers.empty(spark)).count() == 0


def test_short_and_dotted_credentials(spark):
    """Formats of 8 to 15 characters and with dots, learned from labelled ones, are found where they stand bare, next to base spans too."""
    rng = random.Random(6)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    short = lambda: f"{rng.randrange(10)}{key(4)}-{key(6)}{rng.randrange(10)}"
    dotted = lambda: f"{key(6)}.{key(8)}.{key(6)}"
    rows = [(i, f"set token={short() if i % 2 else dotted()} {helpers.sentence(i, 30)}") for i in range(400)]
    rows += [(1000 + i, f"it says {short()}, {dotted()}. Then é password={dotted()} ends") for i in range(50)]
    rows += [(2000 + i, f"plain {helpers.sentence(i, 40)} words.only here.") for i in range(50)]
    got = {r.doc_id: r for r in secret_grammar.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    hits = {i: [text[i][s.start : s.end] for s in got[i].spans if s.kind == "grammar"] for i in got}
    assert sum(len(hits[1000 + i]) == 2 for i in range(50)) >= 45
    assert sum(bool(hits[2000 + i]) for i in range(50)) <= 2


def test_inference_equals_brute_force():
    """Merged counts: every token's path ends where tokens end, and the counts of the merged states add up to the tree's."""
    rng = random.Random(9)
    tokens = ["ab" * rng.randrange(1, 5) + "1" * rng.randrange(0, 3) for _ in range(300)]
    model = secret_grammar.infer(tokens)
    counts, child = secret_grammar._prefix_tree(tokens)
    ends = {}
    for t in tokens:
        s = 0
        for c in t:
            s = model.to[s][secret_grammar.CLASS_OF[c]]
        ends[s] = ends.get(s, 0) + 1
    through = [0] * len(model.to)
    for t in tokens:
        s = 0
        through[s] += 1
        for c in t:
            s = model.to[s][secret_grammar.CLASS_OF[c]]
            through[s] += 1
    for s, row in enumerate(model.log_p):
        want = (ends.get(s, 0) + 0.05) / (through[s] + 0.05 * (secret_grammar.END + 1))
        assert math.isclose(math.exp(row[secret_grammar.END]), want, rel_tol=1e-9)
