import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from chronosift.llm import fair_mix, queries
from tests.llm import helpers


def brute_targets(by_source):
    order = sorted((s for s in by_source if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in by_source)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(by_source.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * by_source[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2.0 * by_source[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, table):
    """rows: the query's; table: (doc_id, text, source)."""
    per = defaultdict(int)
    for _, text, source in table:
        per[source] += size(text)
    want = brute_targets(dict(per))
    assert Counter((str(r.doc_id), r.size, r.source_size) for r in rows) == Counter((str(d), size(t), per[s]) for d, t, s in table)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in per:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_query_on_data(spark):
    rows = queries.op6_fair_mix(spark, helpers.SF).collect()
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{helpers.SF}/documents.parquet").collect()]
    check(rows, docs)
    assert sorted(map(str, rows)) == sorted(map(str, queries.op6_fair_mix(spark, helpers.SF).collect()))


def test_awkward_rows(spark):
    rows = fair_mix.taken_rows(fair_mix.plan(helpers.clashing(spark))).collect()
    assert len(rows) == len(helpers.awkward_rows()) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert all(r.taken == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert fair_mix.taken_rows(fair_mix.plan(helpers.empty(spark))).count() == 0
    assert fair_mix.mixed(helpers.empty(spark), 2).count() == 0


def test_mix_has_the_copies_of_the_plan(spark):
    docs = helpers.clashing(spark)
    planned = {(str(r.doc_id), r.size): r.first + r.again for r in fair_mix.plan(docs).collect()}
    sent = fair_mix.mixed(docs, 2)
    assert sent.columns == docs.columns
    assert Counter((str(r.doc_id), size(r.text)) for r in sent.collect()) == Counter({k: v for k, v in planned.items() if v})


def test_hot_source_and_many_documents(spark):
    from pyspark.sql import functions as F

    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 50 + 1).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 17)).alias("source"))
    rows = fair_mix.taken_rows(fair_mix.plan(docs)).collect()
    check(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_repeated_rows_are_taken_one_by_one(spark, monkeypatch):
    """Many equal rows: as many are taken as the target has room for, and the mix has as many."""
    monkeypatch.setattr(fair_mix, "REPEATS", 64)
    rows = [(7, "two words", "a")] * 1000 + [(i, "three words here", "b") for i in range(300)] + [(8, "two words", "b")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = fair_mix.taken_rows(fair_mix.plan(docs)).collect()
    check(got, rows)
    per = Counter()
    for r in got:
        per[r.source] += r.taken
    want = brute_targets({"a": 2000, "b": 1300})
    assert all(abs(per[s] - want[s]) <= 3 for s in want)
    sent = fair_mix.mixed(docs, 4).collect()
    assert Counter(size(r.text) for r in sent) == Counter({n: sum(r.taken // r.size for r in got if r.size == n) for n in (2, 3)})


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{helpers.SF}/documents.parquet'")
    got = queries.op6_fair_mix(spark, helpers.SF)
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op6_fair_mix']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_columns_of_any_name_and_type_are_kept(spark):
    """Names that the operator uses itself, and a map, beside repeated rows of which some are taken."""
    names = ["i", "_n", "_part", "_rows", "_own", "_before", "row", "own", "at", "id", "key", "of", "alike", "before", "rows", "h", "again", "first"]
    rows = [(7, "two words", "a")] * 300 + [(i, "three words here", "b") for i in range(90)] + [(8, "two words", "b")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *[F.lit(777).alias(n) for n in names], F.create_map(F.lit("k"), F.col("doc_id")).alias("map"))
    got = fair_mix.mixed(docs, 4)
    assert got.columns == docs.columns
    plan = fair_mix.plan(docs).collect()
    found = got.collect()
    assert Counter(r.doc_id for r in found) == Counter({d: n for d in {r.doc_id for r in plan} if (n := sum(r.first + r.again for r in plan if r.doc_id == d))})
    assert all(r[n] == 777 for r in found for n in names) and all(r["map"] == {"k": r.doc_id} for r in found)
