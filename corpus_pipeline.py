"""Corpus pipeline: documents that the quality classifier keeps, one of each near-duplicate group, mixed to target weights, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, extra columns included.

Nulls and edges: a stage on no rows returns none; null texts count as empty (the mix takes nothing of them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nava.llm import bpe, jaccard, mixing, quality
from nava.llm.queries import tokenizer_file
from nava.session import discard, stored, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; rejected ones go. It learns from the labels of the documents that reach this stage."""
    net = quality.learn(quality.sample(docs, table(spark, sf_dir, "labels")))
    return quality.scored(docs, net, docs.columns).where(F.col(quality.SCORE) >= 0.5).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, ids or not; of rows that repeat an id and its text, one.

    Documents without words link with nothing, so all of them stay.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    kept = stored(jaccard.representatives(docs, key), "kept").withColumnRenamed("key", "__key")
    empty = F.coalesce(F.btrim("text", F.lit(mixing.SPACE)), F.lit("")) == ""
    order = Window.partitionBy("__key").orderBy(F.xxhash64(*docs.columns))
    rows = docs.where(~empty).withColumn("__key", key).join(kept, "__key", "left_semi").withColumn("__row", F.row_number().over(order))
    return rows.where("__row = 1").select(*docs.columns).unionByName(docs.where(empty))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its first word: sources below their target repeat, sources above it lose documents."""
    # Rows find their plan by id, source and text, so rows without an id have theirs.
    key = F.xxhash64(mixing.source_key(), "text")
    plan = mixing.mix(docs, __key=key).where("starts > 0").groupBy(F.col("doc_id").alias("__id"), "__key").agg(F.max("starts").alias("__times"))
    rows = docs.withColumn("__own", key)
    rows = rows.join(plan, rows["doc_id"].eqNullSafe(plan["__id"]) & (rows["__own"] == plan["__key"]))
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return rows.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    return bpe.round_trip(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("jaccard", one_of_each_group), ("mixing", mixed), ("bpe", encoded)]

#: A trained network, a similarity join and BPE are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    before = written(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
            discard(spark, docs, before=before)  # what the stage left besides its result
    return docs
