"""A training corpus from documents: five stages, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) and return the columns of documents, but for the last, which returns packed pieces.
Models are trained on the raw tables' training rows, never on held-out ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard_join, language, mixing, packing, quality
from quire.llm.common import held_out, materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: null texts, texts without a letter, texts far from every language. lang becomes the prediction."""
    model = language.train(table(spark, sf_dir, "documents").where(~held_out(F.col("doc_id"), 4, 2)))
    kept = language.identify(docs.select(COLUMNS), model).where(~F.col("lang_rejected"))
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    raw, labels, fold = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 4, 2)
    model = quality.train(raw.where(~fold), labels.where(~fold))
    return quality.score(docs.select(COLUMNS), model).where(F.col("quality_score") >= quality.THRESHOLD).select(COLUMNS)


def row_key(*columns: str) -> Column:
    """A hash of the columns that tells null from any value."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays: the one with the smallest id, a null id only where no other is left; of rows that
    repeat both id and text, one. Rows are told apart by id and text, so that null or repeated ids lose nothing."""
    keyed = docs.select(*COLUMNS, row_key("doc_id", "text").alias("key"))
    classes = jaccard_join.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"))
    classes = classes.where("component_id IS NOT NULL").select(F.col("doc_id").alias("key"), "component_id").distinct()
    ranked = classes.join(keyed.select("key", "doc_id"), "key").select("component_id", "key", F.struct(F.col("doc_id").isNull(), "doc_id", "key").alias("rank"))
    kept = ranked.groupBy("component_id").agg(F.min("rank")["key"].alias("key")).select("key")
    gone = ranked.select("key").distinct().join(kept, "key", "left_anti")
    return keyed.join(gone, "key", "left_anti").dropDuplicates(["key"]).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to CAP times; documents not taken go. Rows that repeat id, text and source are taken together."""
    taken = mixing.mix(docs.select("doc_id", "text", "source")).where("copies > 0")
    times = taken.select(row_key("doc_id", "source", "tie").alias("key"), "copies").groupBy("key").agg(F.sum("copies").cast("int").alias("times"))
    keyed = docs.select(COLUMNS).withColumn("tie", F.xxhash64("doc_id", "text")).withColumn("key", row_key("doc_id", "source", "tie"))
    return keyed.join(times, "key").dropDuplicates(["key"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text")).drop("ids")


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and sampling are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
