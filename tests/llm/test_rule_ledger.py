import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from chronosift.llm import queries, rule_ledger
from tests.llm import helpers


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            marked |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t$#é🎉 ", max_size=120))
def test_measures_equal_brute_force(text):
    assert rule_ledger.measure_text(text.encode())[:5] == brute(text)


def test_many_distinct_words_need_reranking():
    words = [f"w{i}".encode() for i in range(9000)] * 2
    assert rule_ledger.repeated_words(words) == 18000
    assert rule_ledger.repeated_words(words[:9003]) == 0


def test_awkward_rows(spark):
    rows = rule_ledger.ledger(helpers.clashing(spark), ["doc_id"]).collect()
    want = sorted((str(r[0]), *brute(r[1])) for r in helpers.awkward_rows() if r[0] != 5)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows if r.doc_id != 5) == want
    assert rule_ledger.ledger(helpers.empty(spark), ["doc_id"]).count() == 0


def test_policies_and_ablation(spark):
    entries = rule_ledger.ledger(helpers.awkward(spark), ["doc_id"]).cache()
    rows = entries.withColumn("ok", rule_ledger.passes("v1")).collect()
    used = [i for i in range(len(rule_ledger.RULES)) if rule_ledger.POLICIES["v1"] >> i & 1]
    for r in rows:
        assert r.ok == (not any(r.failed_bits >> i & 1 for i in used))
    got = {r.rule: r for r in rule_ledger.ablation(entries, "v1").collect()}
    assert set(got) == {rule_ledger.RULES[i].name for i in used}
    for i in used:
        g = got[rule_ledger.RULES[i].name]
        assert g.n_failed == sum(r.failed_bits >> i & 1 for r in rows)
        assert g.n_failed_alone == sum(r.failed_bits & rule_ledger.POLICIES["v1"] == 1 << i for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].ok and not by[9].ok and not by[2].ok


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{helpers.SF}/{name}.parquet'")
    for name in ("op9_quality_rules", "quality_rule_ablation", "op7_decontaminate"):
        got = queries.QUERIES[name](spark, helpers.SF)
        rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_bits_summary(spark):
    entries = rule_ledger.ledger(helpers.awkward(spark), ["doc_id"]).cache()
    masks = [r.failed_bits for r in entries.collect()]
    some, every = 0, -1
    for m in masks:
        some, every = some | m, every & m
    assert tuple(rule_ledger.bits_summary(entries).first()) == (len(masks), some, every, sum(m.bit_count() for m in masks))
