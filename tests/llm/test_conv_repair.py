import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from chronosift.llm import conv_repair, queries
from tests.llm import helpers

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Conversations in order of identifier, each with its rows after damage."""
    out = {}
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        act = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        mine = out.setdefault(conv, [])
        if act == 1:
            text = ""
        if act == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if act == 4:
            role = "user"
        mine += [] if act == 0 else [(turn, role, text)] * (2 if act == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def initials_fit(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return not roles or (rest and rest == "ua" * (len(rest) // 2))


def faults_of(rows):
    out = []
    for i, (_, role, text) in enumerate(rows):
        body = text.strip(WHITE)
        again = any((role, text) == r[1:] for r in rows[:i])
        out.append("blank" if not body else "duplicate" if again else "truncated" if body[-1] not in ".!?" else None)
    return out


def brute(rows):
    """All edits of up to two inserts in each place, without dynamic programming; for conversations of a few rows."""
    faults, best = faults_of(rows), None
    ways = [[("D", None)] if f in ("blank", "duplicate") else [("D", None), ("K", None), ("R", "user"), ("R", "assistant")] for f in faults]
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in itertools.product(*ways):
        for more in itertools.product(inserts, repeat=len(rows) + 1):
            audit, turns, cost = "", [], 0
            for i in range(len(rows) + 1):
                for new in more[i]:
                    audit, cost = audit + "I", cost + 3
                    turns.append((new, ""))
                if i < len(rows):
                    letter, role = edits[i]
                    audit += letter
                    cost += {"D": 4, "K": 0, "R": 3}[letter] + (3 if letter != "D" and faults[i] == "truncated" else 0)
                    if letter != "D":
                        turns.append((role or rows[i][1], rows[i][2]))
            if initials_fit("".join(r[:1] or "-" for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in turns)
    return best


def expected(conv, rows):
    faults = faults_of(rows)
    there = [r[0] for r in rows if r[0] is not None]
    first = [r[1][:1] for r in rows]
    cost, audit, text = brute(rows)
    return (
        conv, max(there) - min(there) + 1 - len(set(there)) if there else 0, *(faults.count(f) for f in conv_repair.FAULTS),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reported(df):
    got = conv_repair.reports(conv_repair.edits(conv_repair.damaged(df), absent="gone")).collect()
    return sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str)


def conversations():
    rng = random.Random(2)
    rows = []
    for conv in [*range(60), -3, None]:
        for turn in range(rng.randint(1, 3)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "no", "  ", "", None, "What?\n", "a b c!", "Ünï.", "\x0b.\t"])
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, text))
    return rows


def test_reports_equal_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert reported(df) == sorted((expected(c, r) for c, r in damaged(rows).items()), key=str)


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(conv_repair.oracle()).fetchall()
    return sorted((tuple(r) for r in got), key=str)


def test_sql_equals_brute_force():
    rows = conversations()
    assert oracle(rows) == sorted((expected(c, r) for c, r in damaged(rows).items()), key=str)


@pytest.mark.parametrize(("limit", "block"), [(0, 1), (0, 3), (20, 7)])
def test_blocks_equal_whole_conversations(spark, monkeypatch, limit, block):
    """Conversations cut into blocks, dealt out over tasks, give what those read whole and the SQL give."""
    rng = random.Random(block)
    rows = conversations()
    rows += [(500, rng.choice([t, t // 2, None]), rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"{t}.", f"{t % 7}"])) for t in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = reported(df)
    monkeypatch.setattr(conv_repair, "LONG_ROWS", limit)
    monkeypatch.setattr(conv_repair, "BLOCK", block)
    assert reported(df) == whole == oracle(rows)


def test_edits_are_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "user", ""), (1, 3, "user", "So"), (2, 5, "user", "Hi."), (2, 6, "user", "Hi.")]
    short, long = conv_repair.edits(spark.createDataFrame(rows, SCHEMA))
    assert long is None
    got = [tuple(r) for r in short.collect()]
    assert [r for r in got if r[0] == 1] == [
        (1, "K", 0, "user", "user", "Hi.", None), (1, "R", 1, "user", "assistant", "Still there?", None),
        (1, "D", 2, "user", "user", "", "blank"), (1, "D", 3, "user", "user", "So", "truncated"),
    ]
    assert [r for r in got if r[0] == 2] == [(2, "K", 5, "user", "user", "Hi.", None), (2, "D", 6, "user", "user", "Hi.", "duplicate"), (2, "I", None, None, "assistant", "", None)]


def test_awkward_tables(spark):
    assert reported(spark.createDataFrame([], SCHEMA)) == []
    text = helpers.sentence(3, 30000) + "."
    rows = [(7, 0, "user", text), (7, 1, "assistant", "Ok."), (7, 1, "assistant", "Ok.")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", gone string, edit int, digest int")
    kept = {c: sorted(r) for c, r in damaged(rows).items()}
    got = reported(df)
    assert [g[0] for g in got] == [7] and got[0][3] == faults_of(kept[7]).count("duplicate")


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{helpers.SF}/conversations.parquet'")
    want = sorted((tuple(r) for r in con.execute(conv_repair.oracle()).fetchall()), key=str)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op12_conversation_repair(spark, helpers.SF).collect()), key=str)
    assert got == want
