"""The corpus pipeline: five stages, each a whole-table Spark job over its predecessor's rows.

quality classifier (rejected documents go), line dedup, near-dedup at a five-word Jaccard
similarity of 0.8 (the smallest ``doc_id`` of each group stays), suffix-array dedup and packing.  All but the last
return the columns of ``documents``, with ``n_chars`` brought up to date where text went.

Defined results: a null or empty text is one without words; the quality stage judges it by the
features of an empty text, the near-dedup stage holds all texts without words for copies of one another and keeps
one of them, and packing gives it its end id.  A null ``doc_id`` is an id like any other and
comes last where the smallest one stays; rows that repeat id and text stay once.  Columns
beyond those of ``documents`` go along unread up to packing, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, line_templates, near_copies, packing, quality_bayes, suffix_dedup

#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5
#: A repeated passage has so many bytes, or so many words of whatever length.
REPEAT_BYTES, REPEAT_WORDS = 256, 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_bayes.keep_good(docs, common.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_first(docs, words=SHINGLE)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs, REPEAT_BYTES, REPEAT_WORDS).withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packed),
]

#: Stages train a model and tokenise, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; all but the last are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
