"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, decontaminate, divergence, fertility, html, language, neighbours, packing, pii, sharding, simhash, sql, toxicity, variants
from .common import read


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return neighbours.search(vectors, F.col("id") % 100 == 0)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.round_trip(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op11_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(read(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(read(spark, sf_dir, "documents"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_html": op2_html, "op3_packing": op3_packing, "op9_bitpack": op9_bitpack, "op4_decontaminate": op4_decontaminate, "op5_sharding": op5_sharding, "op6_neighbours": op6_neighbours, "op7_language": op7_language, "op8_simhash": op8_simhash, "op10_pii": op10_pii, "op11_fertility": op11_fertility, "op12_divergence": op12_divergence, "op13_variants": op13_variants}
ORACLE_SQL: dict[str, str] = {"op12_divergence": sql.DIVERGENCE, "op13_variants": sql.VARIANTS}
