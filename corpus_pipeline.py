"""The corpus pipeline: five stages from raw documents to packed windows.

Each stage takes what the stage before it kept, written as Parquet and read again.
The first four return the columns of ``documents``:

* toxicity: toxic documents go; the model is fitted on ``labels``;
* quality: failing lines go from the texts, documents that lose too much go;
* near duplicates: one document of each group stays;
* secrets: found spans are replaced by the name of the rule;
* packing: (doc_id, row_id, window_id, window_offset, doc_start, n_tokens, token_ids), the
  pieces of all documents with their BPE ids; ``row_id`` tells rows apart that share a doc_id.

Defined results: a null text isn't toxic but goes in the quality stage (``null``), as
an empty one does (``empty``); rows that repeat id and text are copies, of which one
stays; a null doc_id is kept as such; extra columns stay until packing; empty tables
give an empty result, and labels without both classes reject nothing.

No stage but quality and secrets can be written in SQL, so there is no oracle;
the tests hold every stage against a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import packing, quality, secrets, simhash, toxicity
from fathom.llm.shared import scratch, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit_from_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.clean_lines(docs).filter("kept")
    made = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, text_col="text")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as made:  # what a stage wrote on its way goes with it
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            if last:
                made.append(last)
            last = next(p for p in made if f"/stage-{name}-" in p)
            made.remove(last)
    return docs
