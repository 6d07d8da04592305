"""A corpus pipeline of five of the training-data operators.

Each stage takes the documents that its predecessor kept and returns documents with the same columns;
the last returns their pieces. Stages don't look back, so each can be written to Parquet and read
again, which is what ``run`` does in the shared folder.

Cases, for all stages: an empty table gives no rows; columns beside doc_id, text, source and n_chars are
kept up to the mix, whatever their names, and are never looked at. Null and empty texts are scored by
the classifier like any other (and mostly rejected), are left alone by line dedup, are one group for the
near copies, cost the mix nothing (it takes them once), and have null or no pieces. Rows without an id
are scored and mixed each by its text, come last in line dedup's order, and all stay in the near copies'
stage. Rows repeated with an id and a text share their decisions; one of them stays as a near copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveflow.llm import line_dedup, mixing, quality, sentpiece, simhash
from sieveflow.llm.common import cut, free_name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.train(docs, labels))


def near_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go; so do documents of which nothing but blanks is left by that."""
    lines, dropped = (free_name(c, docs.columns) for c in ("_lines", "_dropped"))
    out = line_dedup.line_dedup(docs, n_lines=lines, n_dropped=dropped)
    out = out.where((F.col(dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id."""
    return simhash.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two times."""
    return mixing.repeated(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best pieces of each document, and the scores of the three best segmentations."""
    return sentpiece.encode(docs, keep=("doc_id", "source"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", near_line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Neither trees grown on labels nor a piece lattice can be said in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
