"""The corpus pipeline: stages of the training-data operators, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonargrid.llm.exact_dedup import exact_dedup
from sonargrid.llm.language_id import NO_LANGUAGE, learn, predict
from sonargrid.llm.mixing import emit, mix
from sonargrid.llm.ngram_join import near_duplicates
from sonargrid.llm.packing import packed_digests
from sonargrid.llm.shared import cut, drop_cut, without_ids

#: Posterior below which a document's language counts as unknown.
SURE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null texts, texts without a letter and undecided ones go."""
    told = predict(docs, learn(docs))
    return told.where((F.col("lang_pred") != NO_LANGUAGE) & (F.col("score") >= SURE)).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id."""
    return exact_dedup(docs).where("kept").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    found = near_duplicates(docs.select("doc_id", "text"))
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    return without_ids(docs, gone, "doc_id")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks for, 0 to 3 times."""
    return emit(mix(docs)).select(docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences; of a document's copies each is packed."""
    return packed_digests(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mix_stage),
    ("best-fit packing", pack_stage),
]

#: Language ID, near duplicates and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
