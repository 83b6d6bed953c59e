"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

1. quality: documents that the co-trained quality classifier rejects go.
2. near_duplicates: of each group of documents linked by five-word shingles (Jaccard of 0.8 or more) the one of least
   doc_id stays.
3. personal_data: spans of personal data are replaced by their kind in brackets; n_chars is counted anew.
4. mixture: sources are mixed to target weights; a document stands in the mix as often as it is taken.
5. pieces: doc_id, source, lang and the SentencePiece ids of each document of the mix.

:func:`run` hands texts to Python at most :data:`BATCH_ROWS` rows at once, and leaves the session's own setting as it was.

Stages but the last return the columns of ``documents``, further ones included, whatever their names. Documents with
null or empty texts pass through the stages that don't reject them. Of near copies that tie the least doc_id stays; of
rows with the same doc_id and text one stays; rows without doc_id stay. An empty table gives an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, ngram_join, pii, quality, sentencepiece_codec
from gridloom.llm.common import batch_rows, keep

BATCH_ROWS = 2000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=5, percent=80)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode(docs.select("doc_id", "source", "lang", "text"))
    return coded.select("doc_id", "source", "lang", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixture", mixture_stage),
    ("pieces", piece_stage),
]

#: SQL can't express the classifiers, the boosted spans and the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with batch_rows(spark, BATCH_ROWS):
        for name, stage in STAGES:
            docs = keep(stage(spark, docs, sf_dir), name)
    return docs
