"""Repair of conversations' structure by cheapest edits, with a bidirectional DAG of tight arcs.

A conversation's rows are to become ``(s? (ua)+)?`` by initials of their roles: at
most one system turn, then user and assistant in turn. Nodes of the DAG are (rows
read, state); its arcs are the edits Delete, Insert, Keep and Rerole with their
costs. Minimum costs from the start (forward) and to the end (backward) tell
which arcs are tight, that is on some cheapest path; the audit is found by
walking tight arcs from the start, taking those of the least letter at each
step. A letter leads from a state to one state only, so the frontier that
shares the letters so far is one node.

Costs through a row are a 4 x 4 matrix over (min, +), which can be put
together. Conversations of up to LONG_ROWS rows and LONG_CHARS characters are
read whole in one task. Longer ones, so that one with a third of all rows does
not meet in a task, are cut into blocks of BLOCK rows: a matrix for each block,
their products from both ends, then each block finds its tight arcs by itself.

Cases: null role or text count as empty; a text without a character other than
white space is blank, whatever its length; rows of one turn are ordered by role
and by the hash (md5) of the text, null turns first; repeated rows are duplicates; null identifiers are
one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.llm.common import small, small_batches
from chronosift.llm.ordering import placed

WHITE = b"\x09\x0a\x0b\x0c\x0d\x20"
#: Beyond these a conversation is cut into blocks of so many rows.
LONG_ROWS, LONG_CHARS, BLOCK = 10_000, 4_000_000, 10_000

# --- the DAG -------------------------------------------------------------------------------------

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, ENDS = 0, (0, 3)
#: What a turn of this initial makes of a state.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
TURN = STEP["u"] | STEP["a"]
COST = {"D": 4, "I": 3, "K": 0, "R": 3}
TRUNCATED_COST = 3
NEVER = 1 << 40

# Kinds of rows, a character each: g not there, d to be deleted, else the initial (o: any other), a capital if the text is truncated.


@cache
def edits_of(kind: str) -> list[tuple[str, int, dict[int, int]]]:
    """Edits (letter, cost, state to state) that read a row of a kind, by letter."""
    if kind == "g":
        return [("", 0, {s: s for s in range(4)})]
    out = [("D", COST["D"], {s: s for s in range(4)})]
    if kind != "d":
        more = TRUNCATED_COST if kind.isupper() else 0
        out += [("K", COST["K"] + more, STEP[kind.lower()]), ("R", COST["R"] + more, TURN)]
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product over (min, +)."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), NEVER)


def _matrix(steps: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    out = np.full((4, 4), NEVER, dtype=np.int64)
    for c, step in steps:
        for s, t in step.items():
            out[s, t] = min(out[s, t], c)
    return out


_ONE = _matrix([(0, {s: s for s in range(4)})])
_INSERT = np.minimum(_ONE, _matrix([(COST["I"], TURN)]))
#: Any number of inserts: beyond three they only come back to a state at a cost.
INSERTS = times(times(_INSERT, _INSERT), _INSERT)
_END = np.array([0 if s in ENDS else NEVER for s in range(4)], dtype=np.int64)
#: Costs from a state to the end behind the last row.
AT_END = times(INSERTS, _END[:, None])[:, 0]


@cache
def row_matrix(kind: str) -> np.ndarray:
    """Inserts before a row, then its edit."""
    return times(INSERTS, _matrix([(c, step) for _, c, step in edits_of(kind)]))


@cache
def row_and_inserts(kind: str) -> np.ndarray:
    return times(row_matrix(kind), INSERTS)


def block_matrix(kinds: str) -> np.ndarray:
    """Costs through all rows of a block, halves put together."""
    if not kinds:
        return _ONE
    m = np.stack([row_matrix(k) for k in kinds])
    while len(m) > 1:
        odd = m[len(m) & ~1 :]
        m = np.concatenate([times(m[: len(m) & ~1 : 2], m[1::2]), odd])
    return m[0]


def tight(kinds: str, before: tuple[int, ...], after: tuple[int, ...], last: bool) -> Iterator[tuple[int, int, str, int]]:
    """Tight arcs (rows read, state, letter, next state) of a block.

    before: costs from the start to the states at the block's first row, after:
    from the states behind its last row to the end; after the last block
    inserts may follow.
    """
    forward = [times(np.array(before)[None, :], INSERTS)[0]]
    for k in kinds:
        forward.append(np.minimum((forward[-1][:, None] + row_and_inserts(k)).min(0), NEVER))
    backward = [np.array(after)]
    for k in reversed(kinds):
        backward.append(np.minimum((row_matrix(k) + backward[-1][None, :]).min(1), NEVER))
    backward.reverse()
    best = int((forward[0] + backward[0]).min())
    f, b = [x.tolist() for x in forward], [x.tolist() for x in backward]
    for i in range(len(kinds) + last):
        for s, t in TURN.items():
            if f[i][s] + COST["I"] + b[i][t] == best:
                yield i, s, "I", t
        if i < len(kinds):
            for letter, c, step in edits_of(kinds[i]):
                for s, t in step.items():
                    if f[i][s] + c + b[i + 1][t] == best:
                        yield i, s, letter, t


def walk(kinds: str, before: tuple[int, ...], after: tuple[int, ...], last: bool, entry: int) -> tuple[list[str], int]:
    """The least letters from a state along tight arcs, those of each row (and of what follows the last row if last), and the state behind."""
    arcs: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for i, s, letter, t in tight(kinds, before, after, last):
        arcs.setdefault((i, s), []).append((letter, t))
    frontier, out = {entry}, []
    for i in range(len(kinds) + last):
        letters = ""
        while True:
            if i == len(kinds) and any(after[s] == 0 and s in ENDS for s in frontier):
                break
            there = [x for s in frontier for x in arcs.get((i, s), [])]
            least = min(there)[0]
            frontier = {t for letter, t in there if letter == least}
            letters += least
            if least != "I":
                break
        out.append(letters)
    return out, min(frontier)


_FROM_START = tuple(0 if s == START else NEVER for s in range(4))


@lru_cache(maxsize=20_000)
def cheapest(kinds: str) -> list[str]:
    """Letters of each row of a whole conversation, inserts before its edit, and those after the last."""
    return walk(kinds, _FROM_START, tuple(AT_END.tolist()), True, START)[0]


def kind_of(role: str, blank: bool, again: bool, cut: bool) -> str:
    if blank or again:
        return "d"
    first = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return first.upper() if cut else first


# --- rows ----------------------------------------------------------------------------------------

FAULTS = ("blank", "duplicate", "truncated")


def _out_schema(id_type: T.DataType, turn_type: T.DataType) -> T.StructType:
    s = T.StringType()
    return T.StructType([T.StructField("conv_id", id_type), T.StructField("edit", s), T.StructField("turn", turn_type), T.StructField("was", s), T.StructField("role", s), T.StructField("text", s), T.StructField("fault", s)])


def _rows(df: DataFrame, absent: str | None) -> DataFrame:
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return df.select("conv_id", "turn", *text, (F.col(f"`{absent}`") if absent else F.lit(False)).alias("gone"))


def edits(df: DataFrame, absent: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The edits of conversations (conv_id, turn, role, text), a row each, in the order of the audit: those of short conversations, and of long ones if there are any.

    edit is the letter; turn and was (the role) are those of the row it reads,
    null for Insert; role and text are those of the repaired turn, or the
    deleted one's; fault is the row's first fault. Rows of a conversation stand
    one after another within a partition.

    absent: a boolean column of rows that are not there, but whose conversation
    is; each gives a row whose edit is empty.
    """
    small_batches(df.sparkSession)
    rows = _rows(df, absent)
    size = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = size.filter((F.col("n") > LONG_ROWS) | (F.col("chars") > LONG_CHARS)).select(F.col("conv_id").alias("long"))
    if long.isEmpty():
        return _short(rows), None
    long = small(long)
    of_long = F.col("conv_id").eqNullSafe(F.col("long"))
    return _short(rows.join(long, of_long, "left_anti")), _long(rows.join(long, of_long, "left_semi"))


def _order() -> list[Column]:
    return [F.col("gone").desc(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _short(rows: DataFrame) -> DataFrame:
    ordered = rows.repartition("conv_id").withColumn("digest", F.md5("text")).sortWithinPartitions("conv_id", *_order()).drop("digest")
    schema = _out_schema(rows.schema["conv_id"].dataType, rows.schema["turn"].dataType)

    def repaired(conv, found: list[tuple]) -> Iterator[tuple]:
        kinds, faults, seen = [], [], set()
        for _, role, text, gone in found:
            body = text.encode().rstrip(WHITE)
            blank, again, cut = not body.strip(WHITE), (role, text) in seen, body[-1:] not in (b".", b"!", b"?")
            if not gone:
                seen.add((role, text))
            kinds.append("g" if gone else kind_of(role, blank, again, cut))
            faults.append(None if gone else next((f for f, x in zip(FAULTS, (blank, again, cut), strict=True) if x), None))
        state = START
        for letters, row, kind, fault in zip(cheapest("".join(kinds)), [*found, None], [*kinds, ""], [*faults, None], strict=True):
            for letter in letters or ([""] if kind == "g" else []):
                yield (conv, *edited(letter, state, row, fault))
                state = after(state, letter, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, conv, chars = [], [], None, 0
        for b in batches:
            for c, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and c != conv:
                    out += repaired(conv, held)
                    held = []
                    if chars > 1 << 20:
                        yield _batch(out, schema)
                        out, chars = [], 0
                conv = c
                held.append(tuple(row))
                chars += len(row[2]) + 100
        if held:
            out += repaired(conv, held)
        if out:
            yield _batch(out, schema)

    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.RecordBatch.from_arrays([pa.array(list(x), type=to_arrow_type(f.dataType)) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)


def after(state: int, letter: str, kind: str) -> int:
    if letter in ("I", "R"):
        return TURN[state]
    return STEP[kind.lower()][state] if letter == "K" else state


def edited(letter: str, state: int, row: tuple | None, fault: str | None) -> tuple:
    """edit, turn, was, role, text and fault of an edit in a state."""
    new = "assistant" if TURN.get(state) == 3 else "user"
    if letter == "I":
        return "I", None, None, new, "", None
    turn, role, text, _ = row
    return letter, turn, role, new if letter == "R" else role, text, fault


# --- long conversations --------------------------------------------------------------------------


def _long(rows: DataFrame) -> DataFrame:
    """The edits of conversations that no task takes whole, each cut into blocks by place."""
    schema = _out_schema(rows.schema["conv_id"].dataType, rows.schema["turn"].dataType)
    size = BLOCK
    at = placed(rows.withColumn("digest", F.md5("text")), "conv_id", _order(), "long")
    # A row is a duplicate unless it is the first of its role and text; only hashes are dealt out for that.
    first = at.filter("NOT gone").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("conv_id", "place").withColumn("new", F.lit(True))
    same_place = lambda other: at["conv_id"].eqNullSafe(other["conv_id"]) & (at["place"] == other["place"])
    rows_ = at.join(first, same_place(first), "left").select(at["*"], F.col("new").isNull().alias("again"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(F.col("gone"), "g").when(blank | F.col("again"), "d").when(cut, F.upper(initial)).otherwise(initial)
    fault = F.when(F.col("gone"), None).when(blank, "blank").when(F.col("again"), "duplicate").when(cut, "truncated")
    rows_ = rows_.withColumn("kind", kind).withColumn("fault", fault)
    block = F.expr(f"place div {size}")
    kinds = rows_.groupBy("conv_id", block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"]), "").alias("kinds"))  # at most BLOCK rows each
    letters = _of_blocks(_walked(kinds), size)
    joined = rows_.join(letters, rows_["conv_id"].eqNullSafe(letters["c"]) & (rows_["place"] == letters["p"]), "right")
    ordered = joined.withColumn("conv_id", F.col("c")).repartition("conv_id").sortWithinPartitions("conv_id", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, state, letters, turn, role, text, gone, kind, fault in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                for letter in letters or ([""] if gone else []):
                    out.append((conv, *edited(letter, state, (turn, role, text, gone), fault)))
                    state = after(state, letter, kind)
            if out:
                yield _batch(out, schema)

    return ordered.select("conv_id", "state", "letters", "turn", "role", "text", "gone", "kind", "fault").mapInArrow(run, schema)


def _walked(kinds: DataFrame) -> DataFrame:
    """(conv_id, block, kinds, before, after, entry, last): costs at both ends of each block, and the state it is entered in.

    What one task gets of a conversation is a row of some numbers for each
    block of BLOCK rows.
    """
    conv = kinds.schema["conv_id"]
    ends = "before array<long>, after array<long>, last boolean"

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [block_matrix(k).ravel().tolist() for k in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m, type=pa.list_(pa.int64()))], names=[*b.schema.names, "m"])

    def put_together(key, pdf):
        pdf = pdf.sort_values("block")
        ms = [np.array(m).reshape(4, 4) for m in pdf["m"]]
        before, after_ = [np.array([_FROM_START])], [AT_END[:, None]]
        for m in ms[:-1]:
            before.append(times(before[-1], m))
        for m in ms[:0:-1]:
            after_.append(times(m, after_[-1]))
        pdf["before"], pdf["after"] = [x[0].tolist() for x in before], [x[:, 0].tolist() for x in reversed(after_)]
        pdf["last"] = [False] * (len(ms) - 1) + [True]
        return pdf[["conv_id", "block", "before", "after", "last"]]

    def entered(key, pdf):
        pdf = pdf.sort_values("block")
        state, out = START, []
        for to in pdf["to"]:
            out.append(state)
            state = int(to[state])
        pdf["entry"] = out
        return pdf[["conv_id", "block", "entry"]]

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = []
            for k, x, y, last in zip(*(b.column(n).to_pylist() for n in ("kinds", "before", "after", "last")), strict=True):
                to.append([_exit(k, tuple(x), tuple(y), last, s) for s in range(4)])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(to, type=pa.list_(pa.int64()))], names=["conv_id", "block", "to"])

    id_ = f"conv_id {conv.dataType.simpleString()}"
    m = kinds.select("conv_id", "block", "kinds").mapInArrow(matrices, f"{id_}, block long, kinds string, m array<long>")
    both = m.select("conv_id", "block", "m").groupBy("conv_id").applyInPandas(put_together, f"{id_}, block long, {ends}")
    known = _with(kinds, both)
    to = known.mapInArrow(exits, f"{id_}, block long, to array<long>")
    return _with(known, to.groupBy("conv_id").applyInPandas(entered, f"{id_}, block long, entry long"))


def _exit(kinds: str, before: tuple, after_: tuple, last: bool, state: int) -> int:
    """Where tight arcs lead from a state; itself where none leaves it."""
    try:
        return walk(kinds, before, after_, last, state)[1]
    except ValueError:  # no tight arc: no cheapest path comes this way
        return state


def _with(blocks: DataFrame, more: DataFrame) -> DataFrame:
    other = more.withColumnRenamed("conv_id", "c").withColumnRenamed("block", "b")
    return blocks.join(other, blocks["conv_id"].eqNullSafe(other["c"]) & (blocks["block"] == other["b"])).drop("c", "b")


def _of_blocks(walked: DataFrame, size: int) -> DataFrame:
    """(c, p, letters, state): the letters of the row at each place and the state before them; a conversation's last place has what follows its last row."""
    id_ = walked.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, block, kinds, before, after_, last, state in zip(*(b.column(n) for n in ("conv_id", "block", "kinds", "before", "after", "last", "entry")), strict=True):
                kinds, state, states = kinds.as_py(), state.as_py(), []
                letters = walk(kinds, tuple(before.as_py()), tuple(after_.as_py()), last.as_py(), state)[0]
                for row, kind in zip(letters, [*kinds, ""], strict=False):
                    states.append(state)
                    for letter in row:
                        state = after(state, letter, kind)
                n = len(letters)
                yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()] * n, type=conv.type), pa.array(np.arange(n) + block.as_py() * size), pa.array(letters), pa.array(states, type=pa.int64())], names=["c", "p", "letters", "state"])

    return walked.mapInArrow(run, f"c {id_}, p long, letters string, state long")


# --- reports -------------------------------------------------------------------------------------


def reports(found: tuple[DataFrame, DataFrame | None]) -> DataFrame:
    """Of each conversation the gaps, counts of faults and illegal neighbours before repair, the cost, the audit and the digest of the repaired turns.

    The edits are read in their order with a running state, whatever their
    number. A digest is one chain, so those of a conversation pass one task.
    """
    short, long = found
    out = _reports(short)
    return out if long is None else out.unionByName(_reports(long))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Report:
    def __init__(self, conv):
        self.conv, self.n, self.audit, self.sha = conv, dict.fromkeys(_COUNTS, 0), [], hashlib.sha256()
        self.last, self.least, self.most, self.turns, self.some = None, None, None, 0, False

    def add(self, edit, turn, was, role, text, fault) -> None:
        if not edit:
            return
        self.audit.append(edit)
        self.n["cost"] += COST[edit] + (TRUNCATED_COST if fault == "truncated" and edit != "D" else 0)
        if edit != "I":
            if fault:
                self.n[fault] += 1
            if turn is not None and turn != self.most:
                self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
            if self.last is not None and self.last + was[:1] not in ("su", "ua", "au"):
                self.n["illegal"] += 1
            self.last = was[:1]
        if edit != "D":
            self.sha.update((b"\n" if self.some else b"") + f"{role}:".encode() + text.encode())
            self.some = True

    def row(self) -> tuple:
        if self.turns:
            self.n["gaps"] = int(self.most - self.least) + 1 - self.turns
        return (self.conv, *self.n.values(), "".join(self.audit), self.sha.hexdigest())


def _reports(found: DataFrame) -> DataFrame:
    schema = T.StructType([found.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out = []
            for conv, *row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Report(conv)
                now.add(*row)
            if out:
                yield _batch(out, schema)
        if now is not None:
            yield _batch([now.row()], schema)

    return found.mapInArrow(run, schema)


# --- the damage of the registered query ----------------------------------------------------------


def damaged(df: DataFrame) -> DataFrame:
    """conversations with the query's damage: by the hash of identifier and turn a row is dropped (gone), emptied, stripped of its stops, repeated or given to the user. Nulls are one space."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    act = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    body = F.when(act == 1, "").when(act == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    times_ = F.explode(F.when(act == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = df.select("conv_id", "turn", F.when(act == 4, "user").otherwise(text("role")).alias("role"), body.alias("text"), (act == 0).alias("gone"), times_.alias("copy"))
    return rows.drop("copy")


def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC of an ASCII text; needs crc_table(t)."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def oracle() -> str:
    """DuckDB SQL for the query: from the last row to the first, the cheapest and then least letters from each state, as one text."""

    def add(cost, letters: str, rest: str) -> str:
        return f"(lpad((substr({rest}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letters}' || substr({rest}, 10))"

    into = [TURN[s] for s in range(4)]
    own = []
    for s in range(4):
        keep = " ".join(f"WHEN ini = '{i}' THEN {add('extra', 'K', f'w{step[s]}')}" for i, step in STEP.items() if s in step)
        kept = f"CASE WHEN del THEN NULL {keep} END" if keep else "NULL"
        own.append(f"least({add(4, 'D', f'w{s}')}, {kept}, CASE WHEN NOT del THEN {add('3 + extra', 'R', f'w{into[s]}')} END) AS o{s}")
    closed = [f"least(o{s}, {add(3, 'I', f'o{into[s]}')}, {add(6, 'II', f'o{into[into[s]]}')}) AS v{s}" for s in range(4)]
    white = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS act FROM conversations, crc_table),
r0 AS (SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role,
  CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE act WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d),
r1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM r0),
r2 AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '{white}') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, substr(role, 1, 1) AS ini,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS ini_before FROM r1),
r AS (SELECT *, blank OR again AS del, CASE WHEN cut THEN 3 ELSE 0 END AS extra FROM r2),
rec AS (
  SELECT conv_id, n + 1 AS i, '000000000' AS v0, '000000006II' AS v1, '000000003I' AS v2, '000000000' AS v3 FROM r GROUP BY conv_id, n
  UNION ALL
  SELECT conv_id, i, {", ".join(closed)} FROM (SELECT conv_id, i, {", ".join(own)} FROM (
    SELECT r.conv_id, r.i, r.del, r.extra, r.ini, rec.v0 AS w0, rec.v1 AS w1, rec.v2 AS w2, rec.v3 AS w3 FROM rec JOIN r ON r.conv_id IS NOT DISTINCT FROM rec.conv_id AND r.i = rec.i - 1) a) b),
best AS (SELECT conv_id, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM rec WHERE i = 1),
letters AS (SELECT conv_id, p, substr(audit, p, 1) AS letter, length(replace(substr(audit, 1, p), 'I', '')) AS i, length(replace(substr(audit, 1, p), 'D', '')) AS e
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best) a),
emitted AS (SELECT l.*, r.role, r.text, r.ini FROM letters l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'),
roles AS (SELECT *, max(CASE WHEN e = 1 AND letter = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM emitted),
repaired AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM roles GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
  count(*) FILTER (i > 1 AND (ini_before || ini) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
"""
