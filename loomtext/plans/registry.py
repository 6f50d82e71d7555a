"""All registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.plans import case_queries, flow_queries, more_queries, page_queries, scalar_queries, table_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (text_queries, scalar_queries, table_queries, page_queries, more_queries, case_queries, flow_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by language: rule triggers, normalising stages, boundaries, counts."""
    counts = text_queries.i02_sentence_counts(spark, sf_dir)
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return counts.join(langs, "doc_id").groupBy("lang").agg(F.count("*").alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
