"""Registered queries of the ten corpus operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import audio, html_templates, packing, quality, repair, secrets, simhash, toxicity, urls
from fathom.llm.bpe import encode_bpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_bpe(docs, keep=["doc_id"], verify=True)


@_query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secrets.scan_secrets(docs.select("doc_id", "text"), path_cols=["doc_id"])


ORACLE["op2_secrets"] = secrets.oracle()


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit_from_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model, keep=["doc_id"])


@_query
def op4_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repair.compress_texts(docs.select("doc_id", "text"))


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(packing.token_lengths(docs, keep=["doc_id"]))


@_query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash.find_copies(docs.select("doc_id", "text"))


@_query
def op7_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.filter_urls(pages.select("page_id", "url"))


ORACLE["op8_url_filter"] = urls.oracle()


@_query
def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio, so the bytes of every document are played as 8-bit PCM at 8 kHz."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audio.features(docs.selectExpr("doc_id", "cast(text AS binary) AS audio"))


@_query
def op10_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.clean_lines(docs.select("doc_id", "text")).drop("text")


ORACLE["op10_quality_lines"] = quality.oracle()
