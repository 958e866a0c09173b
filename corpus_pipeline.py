"""From raw documents to token counts: five stages, each on all that the one before kept.

Stages read and return the columns of the documents table; the last returns a row for each
encoded text.  Each stage's result is written as Parquet and read again by the next one.

In every stage an empty table gives an empty one, columns beyond those named pass through
whatever they are called, and rows that are alike in all columns are rows of their own unless the
stage's docstring says that copies go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.byte_bpe import encode_bpe
from gridloom.llm.common import name, shared_folder, table
from gridloom.llm.labelled import remainder
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.quality_model import score_quality
from gridloom.llm.queries import tokenizer
from gridloom.llm.simhash import representatives
from gridloom.llm.source_mix import mixed_documents


def _carried(docs: DataFrame) -> DataFrame:
    """docs with all but id and text in one struct, so that no operator's column takes its place."""
    rest = [F.col(name(c)) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("doc_id"), *rest).alias("rest"))


def _like(docs: DataFrame, result: DataFrame) -> DataFrame:
    """What an operator made of _carried(docs), in the columns of docs."""
    return result.select(*[F.col(c if c in ("doc_id", "text") else f"rest.{name(c)}").alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half go.

    A null text is scored as an empty one and comes back empty.  Rows with a null or a repeated id
    are scored each by its own text; labels are joined by id for learning only.  Repeated rows
    have the same score and stay or go together.  Without labels of both kinds all rows have the
    share of label 1.
    """
    train = remainder("doc_id", 3) != 1
    scored = score_quality(_carried(docs), table(spark, sf_dir, "labels"), train=train)
    return _like(docs, scored.where(F.col("score") >= 0.5))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; the documents stay, emptied ones included.

    A null text is one empty line and comes back as an empty text.  Rows with the same id count
    as one document, so they keep the lines that they alone share; a null id comes after all
    others, and rows without ids count as one document.  n_chars is that of the text left.
    """
    out = _like(docs, dedup_lines(_carried(docs)))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays, the one with the smallest id.

    Rows with a null or a repeated id are rows of their own: each group they are in keeps one.
    Where the smallest id is repeated or there is none, a digest of the whole row decides, so
    reruns agree; rows alike in all columns are copies.  Null, empty and blank texts are one
    group, as their fingerprints are equal.
    """
    return representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole number.

    A null source is one of its own, after the others.  Null, empty and blank texts have no words
    and go.  Rows with a null or a repeated id are documents of their own and keep their columns;
    of rows with the same id and text the other columns break ties, so reruns agree.
    """
    return mixed_documents(docs).select(*[F.col(name(c)) for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each text of the mix: its ids' number and digest, and its decoded bytes' digest.

    A null text is encoded as an empty one, which has no ids; ids and sources pass through, null
    or repeated.
    """
    encoded = encode_bpe(docs, *tokenizer(), want_ids=False)
    return encoded.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: SQL has neither the classifier nor the encoding; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for label, stage in STAGES[:-1]:
        path = shared_folder(spark, label)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
