"""The training-corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Edge cases, from end to end: a text that is null, empty or blank is judged by the quality
model like any other, has no lines to drop, is a near-duplicate of all others without words,
of which one stays, is never contaminated, and has no tokens to mix, so that it is in no
result. Texts of any length are read whole. Repeated rows, and rows of one id and text, are
one class of near-duplicates, of which one row stays. Of equal documents the first keeps its
lines, a row without an id before all others; the rest lose theirs and go as texts without
words. Of near-duplicates that of the smallest id stays, a row without an id only where
its class has none other. A null lang or source is
a leaf of its own in the mixture. An empty documents table, or one without any labelled
document, gives an empty result at the first stage or rejects nothing; an empty benchmark
table contaminates nothing. Other columns of documents, whatever their names, pass through
all stages but the last, which adds its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam_sa, line_templates, quality_gam, simhash_vptree
from tidemark.llm.common import stored, table
from tidemark.llm.queries import mixed


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts; it learns from the labels of all ids."""
    return quality_gam.keep_good(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines whose template recurs across documents."""
    out = line_templates.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates."""
    return simhash_vptree.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of benchmark items."""
    return decontam_sa.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents and epochs that fill the token budget by the target weights."""
    return mixed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("mixing sources to target weights", mixture),
]

#: The first stage is a trained model and the third a fingerprint search: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each leaves is written as Parquet to the shared
    checkpoint folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
