"""From raw documents to token shards: quality rules, near duplicates, decontamination, mixing, output.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents:

1. ``quality``: documents that policy v1 of the rule ledger rejects go.
2. ``near_duplicates``: of each group of documents linked by shared shingles
   that with the smallest identifier stays.
3. ``decontamination``: documents with a window of a benchmark item go.
4. ``mixing``: weighted fair queueing; a document that the mix takes twice is
   there twice.
5. ``token_shards``: sorted string tables of token ids; returns a row for each
   document, read back from the files.

Near duplicates and contaminated rows are known by identifier and text, so that
rows which share an identifier, or have none, are decided each by its own text;
see the operators for nulls, empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronosift.llm import fair_mix, partenum, rule_ledger, sstable, winnow
from chronosift.llm.common import settle, table
from chronosift.llm.queries import END_ID, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ledger.passing(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return partenum.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fair_mix.mixed(docs, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    manifest, n = sstable.encode_to_shards(spark, docs, tokenizer_path(), END_ID)
    return sstable.read(manifest, n)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token shards", token_shards),
]

#: Token ids and the shared shingles of components are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a table folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, "stage")
    return docs
