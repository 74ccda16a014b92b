"""The corpus queries: each applies its operator to its whole table. `QUERIES` and `ORACLES` go to the driver's entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketflow.llm import cross_polytope, decontaminate, filter_audit, license_scan, ngram_join, packing, pii, prefix_trie, quality_rules, quotation, suffix_dedup, toxicity, warc
from basketflow.llm.common import scratch, table
from basketflow.llm.oracles import DECONTAMINATION, FILTER_AUDIT, NGRAM_JACCARD, PREFIX_TRIE, SUFFIX_DEDUP, WARC_REVISIT


def tokenizer_path() -> str:
    """The public byte-level vocabulary, where the machine has it installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.scan(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scan(docs.select("doc_id", "text"), lexicon).select("doc_id", "held_out", "score", "predicted")


def op6_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op9_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link(table(spark, sf_dir, "conversations"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.scan(table(spark, sf_dir, "conversations"))


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.scan(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_ngram_jaccard,
        op3_quality_rules,
        op4_license_scan,
        op5_toxicity,
        op6_warc_revisit,
        op7_cost_packing,
        op8_pii_deobfuscation,
        op9_suffix_decontamination,
        op10_quotation_threads,
        op11_prefix_trie,
        op12_cross_polytope,
        op13_filter_audit,
    )
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": SUFFIX_DEDUP,
    "op2_ngram_jaccard": NGRAM_JACCARD,
    "op6_warc_revisit": WARC_REVISIT,
    "op9_suffix_decontamination": DECONTAMINATION,
    "op11_prefix_trie": PREFIX_TRIE,
    "op13_filter_audit": FILTER_AUDIT,
}
