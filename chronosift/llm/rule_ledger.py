"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger holds the
measurements and one integer whose bits tell which rules failed. Policies are
versioned sets of bits; applying one, or finding what a rule alone rejects, is
bit arithmetic on the ledger, without reading a text again.

Cases: a null text is measured as an empty one (no words, which fails
``few_words``); a text of any length is measured whole; a document exactly at a
rule's limit passes it; empty tables give empty ledgers; repeated rows give
repeated ledger rows; other columns of the table, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.llm.common import map_text, settle

MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha", "n_upper", "n_marks", "n_digits")])

_SPACE, _SYMBOL, _UPPER, _LOWER, _HIGH, _CONT, _MARK, _DIGIT, _REST = range(9)


def _classes() -> np.ndarray:
    table = np.full(256, _REST, dtype=np.uint8)
    table[[*range(9, 14), 32]] = _SPACE
    table[[ord(c) for c in "#*$%&|<>"]] = _SYMBOL
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[ord("a") : ord("z") + 1] = _LOWER
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[[ord("!"), ord("?")]] = _MARK
    table[0x80:0xC0] = _CONT
    table[0xC0:] = _HIGH
    return table


CLASSES = _classes()
WINDOW = 5


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of width words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    if len(seen) == len(words):
        return 0
    key, base = ids[:n].copy(), len(seen)
    room = base
    for i in range(1, width):
        if room > (1 << 62) // base:  # re-rank, so that keys stay exact in 64 bits
            ranks = np.unique(key, return_inverse=True)
            key, room = ranks[1].astype(np.int64), len(ranks[0])
        key = key * base + ids[i : i + n]
        room *= base
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    delta = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.nonzero(twice)[0]
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + width, -1)
    return int((np.cumsum(delta)[:-1] > 0).sum())


def measure_text(raw: bytes | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not raw:
        return (0,) * len(MEASURES)
    words = raw.split()
    c = np.bincount(CLASSES[np.frombuffer(raw, dtype=np.uint8)], minlength=9)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    points = len(raw) - int(c[_CONT])
    return (
        len(words),
        points - int(c[_SPACE]),
        int(c[_SYMBOL]),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(c[_UPPER] + c[_LOWER] + c[_HIGH]),
        int(c[_UPPER]),
        int(c[_MARK]),
        int(c[_DIGIT]),
    )


def _kernel(batches: Iterator[list[bytes | None]]) -> Iterator[list[pa.Array]]:
    for texts in batches:
        rows = np.array([measure_text(x) for x in texts], dtype=np.int64).reshape(len(texts), len(MEASURES))
        yield [pa.array(rows[:, i]) for i in range(rows.shape[1])]


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and the measurements of every whole text."""
    return map_text(docs, text_col, MEASURES, _kernel, keep)


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` holds on its measurements."""

    name: str
    fails: str


#: The place of a rule is its bit. New rules go to the end; none is reused.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule("few_letters", "2 * n_alpha < word_chars"),
    Rule("shouting", "10 * n_upper > 6 * n_alpha AND n_alpha > 0"),
    Rule("marks", "10 * n_marks > 5 * n_words"),
    Rule("digits", "10 * n_digits > 4 * word_chars"),
    Rule("huge", "n_words > 1000000"),
)
BIT = {r.name: i for i, r in enumerate(RULES)}


def policy(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


#: Versioned policies: the bits for which a document is rejected.
POLICIES = {
    "base": policy("few_words", "repeated_windows"),
    "v1": policy("few_words", "repeated_windows", "symbols", "few_letters", "shouting", "marks"),
    "v2-strict": policy(*(r.name for r in RULES)),
}


def failure_bits() -> Column:
    mask = F.lit(0).cast("long")
    for i, r in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return mask


def ledger(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, the measurements and ``failed_bits``; names of keep must not be those of measurements."""
    return measure(docs, keep, text_col).withColumn("failed_bits", failure_bits())


def stored(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ledger, written to the shared folder: policies and ablations read it and no text again."""
    return settle(ledger(docs, keep, text_col), "ledger")


def passes(version: str, bits: str = "failed_bits") -> Column:
    """Whether the ledger row passes a policy."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def passing(docs: DataFrame, version: str, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that pass a policy."""
    own = {c: f"own{i}" for i, c in enumerate(docs.columns)}
    body = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    return ledger(body, list(own.values()), own[text_col]).filter(passes(version)).select(*[F.col(n).alias(c) for c, n in own.items()])


def ablation(entries: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: rows failing it, rows failing it alone, rows kept without it.

    The ledger shrinks to a count for each mask that occurs, at most two to the
    power of the rules and far fewer in fact; bit arithmetic on the masks does
    the rest.
    """
    chosen = F.lit(POLICIES[version]).cast("long")
    masks = entries.groupBy(F.col("failed_bits").bitwiseAND(chosen).alias("mask")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if POLICIES[version] >> i & 1])
    each = masks.select("mask", "n", F.explode(rules).alias("r"))
    has, alone = F.col("mask").bitwiseAND(F.col("r.bit")) != 0, F.col("mask") == F.col("r.bit")
    of = lambda what: F.sum(F.when(what, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy(F.lit(version).alias("policy"), F.col("r.rule").alias("rule")).agg(of(has).alias("n_failed"), of(alone).alias("n_failed_alone"), of((F.col("mask") == 0) | alone).alias("n_kept_without"))


def bits_summary(entries: DataFrame) -> DataFrame:
    """One row: documents, rules that some document fails and that all fail (bitwise OR and AND of the masks), and failures in all (bits counted)."""
    return entries.agg(F.count("*").alias("n_docs"), F.bit_or("failed_bits").alias("some_fail"), F.bit_and("failed_bits").alias("all_fail"), F.coalesce(F.sum(F.bit_count("failed_bits")), F.lit(0)).cast("long").alias("n_failures"))


#: What is no letter to the ledger: ASCII but A-Z and a-z.
LETTERS = r"[\x00-@\[-`{-\x7F]"


def _sql_ledger() -> str:
    """DuckDB SQL of the ledger's columns as the common table expression ``ledger``."""
    word, count = r"[^\x20\x09-\x0D]+", lambda c: rf"length(regexp_replace(t, '{c}', '', 'g'))"
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))
    return rf"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents
), windows AS (
    SELECT row, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS w FROM (SELECT row, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)
), twice AS (
    SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, w) AS n FROM windows) WHERE n > 1
), repeated AS (
    SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(i, i + {WINDOW})) AS place FROM twice) GROUP BY row
), lines AS (
    SELECT row, count(*) AS n, count(DISTINCT line) AS n_distinct FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY row
), measured AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        {count(r"[^#*$%&|<>]")} AS n_symbols, coalesce(l.n - l.n_distinct, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
        {count(LETTERS)} AS n_alpha, {count(r"[^A-Z]")} AS n_upper, {count(r"[^!?]")} AS n_marks, {count(r"[^0-9]")} AS n_digits
    FROM d LEFT JOIN lines l USING (row) LEFT JOIN repeated r USING (row)
), ledger AS (
    SELECT *, ({bits})::BIGINT AS failed_bits FROM measured
)"""


def oracle(version: str = "v1") -> str:
    """DuckDB SQL of the query over the ledger."""
    return _sql_ledger() + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {POLICIES["base"]}) <> 0 AS base_failed, (failed_bits & {POLICIES[version]}) = 0 AS kept, failed_bits FROM ledger
"""


def oracle_ablation(version: str = "v1") -> str:
    """DuckDB SQL of the ablation."""
    rules = ", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(RULES) if POLICIES[version] >> i & 1)
    return _sql_ledger() + f"""
SELECT '{version}' AS policy, rule, count_if(mask & bit <> 0)::BIGINT AS n_failed, count_if(mask = bit)::BIGINT AS n_failed_alone, count_if(mask = 0 OR mask = bit)::BIGINT AS n_kept_without
FROM (SELECT failed_bits & {POLICIES[version]} AS mask FROM ledger), (VALUES {rules}) r(rule, bit) GROUP BY rule
"""
