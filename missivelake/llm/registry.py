"""Queries and SQL of the training-data operators, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missivelake.llm import decontamination, fim, html, huffman, line_dedup, ngram_join, packing, pii, quality, topk, toxicity, vector_codes, warc
from missivelake.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(read(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_ngram_join, op3_quality, op4_toxicity, op5_line_dedup, op6_pii, op7_topk, op8_html, op9_packing, op10_huffman, op11_warc, op12_fim,
        op13_vector_codes,
    )
}
ORACLES: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE_SQL, "op2_ngram_join": ngram_join.ORACLE_SQL, "op5_line_dedup": line_dedup.ORACLE_SQL, "op7_topk": topk.ORACLE_SQL,
    "op11_warc": warc.ORACLE_SQL, "op12_fim": fim.ORACLE_SQL, "op13_vector_codes": vector_codes.ORACLE_SQL,
}
