"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm import decontaminate, merkle, mixing, periodic_runs, url_rules, warc
from flowloom.llm.decontaminate import mark_contamination
from flowloom.llm.language_id import train_and_identify
from flowloom.llm.main_text import extract_main_text
from flowloom.llm.media import media_features, to_media
from flowloom.llm.simhash import near_duplicate_groups
from flowloom.llm.suffix_tree_lm import score_texts
from flowloom.llm.token_counts import count_tokens
from flowloom.llm.tree_bpe import bpe_digests
from flowloom.session import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_texts(spark, sf_dir)).drop("text")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_texts(spark, sf_dir)).drop("text")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_texts(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(_texts(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_digests(table(spark, sf_dir, "pages"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return train_and_identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_contamination(_texts(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("text")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(to_media(_texts(spark, sf_dir)).drop("text")).drop("media")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    texts = texts.withColumn("text", periodic_runs.planted(F.col("text"), F.col("doc_id")))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(texts, with_texts=False))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), changes={"text": merkle.tampered_text()})


_ALL = (
    op1_token_counts,
    op2_byte_bpe,
    op3_lm_scoring,
    op4_simhash,
    op5_warc,
    op6_url_filters,
    op7_main_text,
    op8_language_id,
    op9_decontamination,
    op10_media,
    op11_mixing,
    op12_periodic_runs,
    op13_merkle,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: What DuckDB can say in SQL.
ORACLES: dict[str, str] = {
    "op5_warc": warc.ORACLE,
    "op6_url_filters": url_rules.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op11_mixing": mixing.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
