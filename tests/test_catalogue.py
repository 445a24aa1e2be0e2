"""Every query against its SQL counterpart, at the smallest size."""

import math
import os

import duckdb
import pytest

from chronosift.plans import catalogue, composites, exchange  # noqa: F401  (the others add their queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = lambda v: f"{v:.5f}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(flat(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(cur.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_corpus_package():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.ORACLE_SQL) <= set(entry.oracle_sql())


def test_outer_merge_has_all_event_types(spark, con):
    rows_ = catalogue.QUERIES["series_outer_merge_all"](spark, SF).collect()
    types = {t for (t,) in con.execute("SELECT DISTINCT event_type FROM events").fetchall()}
    assert len(types) > 2 and {r["var"] for r in rows_ if r.value is not None} == types
    assert len(rows_) == len(types) * len({(r.client_id, r.hour) for r in rows_})
