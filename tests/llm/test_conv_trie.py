import hashlib
import random
import re
import zlib

import duckdb
import pytest

from chronosift.llm import conv_trie, queries
from tests.llm import helpers

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(f"{role}:{text}".encode()).digest(), role, text))
    turns = {c: [t[3:] for t in sorted(x)] for c, x in turns.items()}
    members, ends = {}, {}
    for c in turns:
        base, h = c - (c % 20 if c >= 0 else -(-c % 20)), zlib.crc32(str(c).encode()) % 4
        seq = tuple(turns.get(base, [])[:h] + turns[c][h:])
        ends.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {k: [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k] for k in members}
    below = {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        below[k] = (sum(below[x][0] for x in children[k]) or 1, own + sum(below[x][1] for x in children[k]))
    return sorted(
        (
            (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *below[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
            for k, m in members.items()
        ), key=str,
    )


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in conv_trie.trie(df).collect()), key=str)


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows) if rows else None
    return sorted((tuple(r) for r in con.execute(conv_trie.oracle()).fetchall()), key=str)


def conversations():
    rng = random.Random(5)
    rows = []
    for conv in [*range(0, 70), -1, -20, -25, 999, None, 400]:
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b", "a  b c", None, "", "ü\x0bé"])))
    return rows


def test_trie_equals_brute_force_and_sql(spark):
    rows = conversations()
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert got == brute(rows) == oracle(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 33, 300])
def test_deep_chains(spark, n):
    """One conversation longer than a task's share, and copies of a part of it: rounds of doubling reach the top."""
    rows = [(40, t, "user", f"w{t} x") for t in range(n)]
    rows += [(c, t, "user", f"w{t} x") for c in (41, 42, 43, 60) for t in range(n // 2)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_equal_rows_and_one_hot_conversation(spark):
    """Rows that are equal in all columns, among them ones that several tasks have."""
    rows = [(7, 0, "user", "same")] * 200 + [(7, 1, "user", f"t{i}") for i in range(50)] + [(8, None, None, None)] * 3 + [(0, 0, "user", "same")]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_awkward_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == [] == oracle([])
    only = [(None, 0, "user", "x")]
    assert found(spark.createDataFrame(only, SCHEMA)) == []
    # A conversation whose turns are all replaced by those of an absent one: the root alone.
    bare = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(bare, 0, "user", "x")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == [(bare, 0, None, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())]
    rows = [(3, 0, "user", helpers.sentence(3, 20000)), (4, 0, "user", "b")]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], SCHEMA + ", place string, a int, depth double")
    assert found(df) == brute(rows)


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{helpers.SF}/conversations.parquet'")
    want = sorted((tuple(r) for r in con.execute(conv_trie.oracle()).fetchall()), key=str)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op13_conversation_trie(spark, helpers.SF).collect()), key=str)
    assert got == want
