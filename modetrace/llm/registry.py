"""The queries of this subpackage, by name; each applies one operator with
production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bloom_lm, bpe, fim, main_text, maxscore, mixing, pii, quality, secret_scan, simhash, simple8b, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.verdicts(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = simple8b.encode(table(spark, sf_dir, "documents"))
    return simple8b.digests(simple8b.decode(spark, shards))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.components(table(spark, sf_dir, "documents")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.roundtrip(table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digests(mixing.mix(table(spark, sf_dir, "documents")))


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search_own(table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.digests(quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels"))))


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.held_out_scores(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.main_text(pages, main_text.fit(pages))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.restore(fim.transform(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_simple8b, op3_simhash, op4_bpe, op5_mixing, op6_maxscore, op7_secrets, op8_quality, op9_bloom_lm, op10_pii, op11_alignment, op12_main_text, op13_fim)}


def oracle_sql() -> dict[str, str]:
    return {"op6_maxscore": maxscore.ORACLE_SQL, "op13_fim": fim.ORACLE_SQL}
