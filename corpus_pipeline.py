"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, contaminated documents go, personal data
is replaced, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir); `run` writes each result as Parquet in the shared scratch folder and rereads it as the
next stage's documents. All but the last return the columns of `documents`. Rows without a doc_id pass like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.llm import decontaminate, ngram_join, packing, pii, toxicity
from basketflow.llm.common import table, written
from basketflow.llm.registered import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from the labels does not predict toxic."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    held = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"), "doc_id", "text")
    kept = toxicity.scan(held, lexicon).where(F.col("predicted") == 0)
    return kept.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, once. An id may stand at unlinked texts; each stays."""
    parts = ngram_join.scan(docs, with_keys=True).where(F.col("doc_id") == F.col("component_id"))
    first = parts.groupBy("key", F.col("doc_id").alias("of_doc")).agg(F.min("digest").alias("of_digest"))
    digest = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    named = docs.where(docs["doc_id"].isNotNull()).join(first, (docs["doc_id"] == first["of_doc"]) & (digest == first["of_digest"]), "left_semi")
    named = named.dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with names of kinds in place of personal data."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: Neither the learned scores nor the tokeniser can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
