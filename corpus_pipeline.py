"""The corpus pipeline: language ID, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what the stage
before it kept, written as Parquet and read again. All stages but the last return the
columns of documents, extra ones included, whatever their names. All of them keep an empty
table empty and take long texts whole.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm.decontaminate import mark_contamination
from flowloom.llm.language_id import train_and_identify
from flowloom.llm.batches import quoted
from flowloom.llm.tree_bpe import encode_bpe
from flowloom.llm.wide_simhash import similar_groups
from flowloom.session import keep, table


def _beside(docs: DataFrame, names: set[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on docs, whose own columns of these names are put aside meanwhile."""
    clash = {c: f"own_{i}_{uuid4().hex}" for i, c in enumerate(docs.columns) if c.lower() in names}
    out = work(docs.withColumnsRenamed(clash))
    return out.select(*[F.col(quoted(clash.get(c, c))).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text (null too) or without a letter, which have no language, go. Rows
    that repeat are each judged."""
    return _beside(docs, {"held_out", "lang_pred", "score"}, lambda d: train_and_identify(d).where(F.col("lang_pred") != "und"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays, once: of rows
    with one doc_id and text, one. A null doc_id is the largest. Null and blank texts are a
    group like others. Shingles are of five words; links are of fingerprints of 256 bits that
    differ in at most 45, which is a similarity of about 0.8."""
    name = f"key_{uuid4().hex}"
    text = F.md5(F.coalesce(F.concat(F.lit("="), "text"), F.lit("")).cast("binary"))
    keyed = docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), text.alias("text")))
    groups = similar_groups(keyed, name)
    first = groups.where(F.col(name) == F.col("component_id")).select(name).distinct()
    return keyed.dropDuplicates([name]).join(first, name, "left_semi").select(*[F.col(quoted(c)) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in twenty is from the benchmark go. Null texts have
    no words and stay; rows that repeat are each judged."""
    benchmark = table(spark, sf_dir, "benchmark")
    names = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated"}
    return _beside(docs, names, lambda d: mark_contamination(d, benchmark).where(~F.col("contaminated")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and the number of these, which replace columns called ids
    or n_tokens. The ids are decoded again: should they not give a document's text, the stage
    fails. A null text has no ids; rows that repeat are each encoded."""
    return encode_bpe(docs, check=True).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: SQL has neither the language model nor the fingerprints; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs
