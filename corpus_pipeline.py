"""A training-data pipeline over ``documents``: five stages, each a Spark job.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept and returns a DataFrame, which is written as Parquet and read again as
the next stage's documents.  All but the last return the columns of
``documents``:

1. ``language``: documents whose language is not recognised go (null texts,
   texts without letters, scores under the calibrated threshold).
2. ``lines``: later copies of repeated line runs are deleted from the texts;
   documents of which nothing is left go.
3. ``near_duplicates``: the first document of each class of near copies stays.
4. ``decontaminate``: documents contaminated by the benchmark go.
5. ``tokenize``: token ids of every remaining text, with digests of the ids
   and of the bytes they decode to.

An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, decontaminate, language, line_dedup, near_dup
from vigil.llm.common import read_table, written
from vigil.session import ensure_conventions


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_conventions(spark)
    return language.drop_rejected(docs, language.fit(docs))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_conventions(spark)
    return line_dedup.dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_conventions(spark)
    return near_dup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_conventions(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_conventions(spark)
    ids = bpe.encode_documents(docs)
    return ids.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_known_languages),
    ("lines", delete_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("tokenize", tokenize),
]

#: Three of the stages are beyond SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    ensure_conventions(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
