"""A corpus made ready for training: five stages, each over all that the one before it kept.

run() writes every stage as Parquet into the shared checkpoint folder and reads it again for the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregrid.llm import line_dedup, mixing, ngram_join, quality_bayes, sentencepiece_sampling
from loregrid.llm.common import checkpoint_dir


def _measured(df: DataFrame, columns: list[str]) -> DataFrame:
    """df's columns, n_chars (if there is such a column) as the text now is."""
    return (df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else df).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Null, empty and blank texts are rejected; null keys, sources and languages are no reason to; equal rows are judged
    alike, whole texts whatever their length; an empty table stays empty; all columns of docs come back.
    """
    return quality_bayes.quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line at its first occurrence only; documents left without any text go.

    Null and blank texts, and rows with a null key, stay as they are; repeated rows with one key keep the same lines;
    texts of any length are gone through whole; an empty table stays empty; all columns of docs come back, n_chars as the
    text now is (null for a null text).
    """
    return _measured(line_dedup.line_dedup(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the lowest id, of each class of near duplicates.

    Rows with a null key, and null, empty and blank texts, stay; repeated rows with the lowest id all stay; texts of any
    length are compared whole; an empty table stays empty; all columns of docs come back.
    """
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of tokens, drawn from the sources by their weights; doc_id is the slot.

    Null and blank texts hold no tokens; null keys and repeated rows are packed like others, and a null source is one of
    its own; long texts go on from block to block; an empty table stays empty. A block is of many documents, so columns
    other than doc_id, text, lang, source and n_chars come back as nulls.
    """
    out = mixing.mix_sources(docs, detail=False)
    return out.select(*(F.col(f.name) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks as sampled piece ids, in place of their texts.

    A null text has null pieces, an empty one none; a null key counts as 0; equal rows are encoded alike; texts of any
    length are encoded whole; an empty table stays empty; all other columns of docs come back.
    """
    return sentencepiece_sampling.sentencepiece_encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mix_sources", mixture),
    ("sentencepiece", encoding),
]

#: The classifier, the draws and the sampled pieces can't be told in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
        if before:
            path = files.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = out
    return docs
