"""The operators as registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import (bpe, cap_filters, collocations, decontaminate, language, line_dedup,
                       near_dup, outliers, quality, secret_scan, spelling, suffix_dedup,
                       token_store)
from vigil.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


@query("op1_line_dedup", line_dedup.ORACLE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


@query("op2_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secret_scan.findings(docs, secret_scan.fit(docs))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"),
                            read_table(spark, sf_dir, "labels"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read_table(spark, sf_dir, "documents"))


@query("op5_token_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_documents(
        token_store.write_shards(read_table(spark, sf_dir, "documents")))


@query("op6_near_dup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(read_table(spark, sf_dir, "documents"))


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.predictions(docs, language.fit(docs)).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op8_outliers")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.digest(outliers.verdicts(read_table(spark, sf_dir, "documents")))


@query("op9_decontaminate")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode_documents(read_table(spark, sf_dir, "documents")))


@query("op11_spelling", spelling.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


@query("op12_cap_filters", cap_filters.ORACLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.dedup(read_table(spark, sf_dir, "embeddings"))


@query("op13_collocations", collocations.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))
