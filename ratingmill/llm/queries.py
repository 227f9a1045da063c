"""The registered queries of this folder, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingmill.llm import bpe, decontam, jaccard, langid, lengths, pii, quality, resample, rules, sharding, trie, urls, winnow
from ratingmill.llm.base import held_out, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.page_labels(pages, table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(table(spark, sf_dir, "documents"), ["doc_id"], table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, ["doc_id"], langid.fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, ["doc_id"], quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(lengths.count_tokens(table(spark, sf_dir, "documents"), [], *bpe.vocabulary()))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"], *bpe.vocabulary())


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.beside_next(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(table(spark, sf_dir, "conversations"), trie.borrowed).drop("path")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pii, op2_ngram_jaccard, op3_sharding, op4_url_filter, op5_decontamination, op6_language_id, op7_quality_classifier, op8_quality_rules, op9_token_counts, op10_byte_bpe, op11_fingerprints, op12_prefix_trie, op13_resampling]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": sharding.ORACLE_SQL, "op4_url_filter": urls.oracle_sql(), "op12_prefix_trie": trie.ORACLE_SQL, "op13_resampling": resample.ORACLE_SQL}
