"""The registered queries of the corpus operators, each a thin digest of an operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.llm import conv_repair, conv_trie, cotrain, fair_mix, lang_kernel, license_rules, minhash_join, partenum, rule_ledger, secret_grammar, sstable, winnow, wordpiece
from chronosift.llm.common import table

#: Appended to each document by op1.
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, n = sstable.encode_to_shards(spark, table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return sstable.read(manifest, n)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prepared = cotrain.views(docs)
    model = cotrain.fit(docs, table(spark, sf_dir, "labels"), prepared=prepared)
    return cotrain.score(docs, model, prepared=prepared).withColumn("kept", F.col("score") >= 0.5)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_rules.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_grammar.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in secret_grammar.KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_grammar.listed(base), 256).alias("base_sha256"), secret_grammar.listed(F.col("spans")).alias("spans"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lang_kernel.predict(docs, lang_kernel.learn(docs), ["doc_id"])
    return found.select("doc_id", lang_kernel.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.taken_rows(fair_mix.plan(table(spark, sf_dir, "documents")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = winnow.hit_words("spans")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.counts(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rule_ledger.stored(table(spark, sf_dir, "documents"), ["doc_id"])
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rule_ledger.passes("base")).alias("base_failed"),
        rule_ledger.passes("v1").alias("kept"),
        "failed_bits",
    )


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, alone or with others, from the stored ledger."""
    return rule_ledger.ablation(rule_ledger.stored(table(spark, sf_dir, "documents"), ["doc_id"]), "v1")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.components(table(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.components(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_repair.reports(conv_repair.edits(conv_repair.damaged(table(spark, sf_dir, "conversations")), absent="gone"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": op1_token_shards,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_licenses": op3_licenses,
    "op4_secrets": op4_secrets,
    "op5_language": op5_language,
    "op6_fair_mix": op6_fair_mix,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_conversation_trie": op13_conversation_trie,
    "quality_rule_ablation": quality_rule_ablation,
}
ORACLE_SQL: dict[str, str] = {
    "op3_licenses": license_rules.oracle(),
    "op6_fair_mix": fair_mix.oracle(),
    "op7_decontaminate": winnow.oracle(),
    "op9_quality_rules": rule_ledger.oracle(),
    "op10_jaccard_join": partenum.oracle(),
    "op11_minhash_dedup": minhash_join.oracle(),
    "op12_conversation_repair": conv_repair.oracle(),
    "op13_conversation_trie": conv_trie.oracle(),
    "quality_rule_ablation": rule_ledger.oracle_ablation(),
}
