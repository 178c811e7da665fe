"""Translations that come from files instead of a service: whole pages of text, texts by position, a cache of any namespace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

MARK = "【译】"
LEAST = 4


def page_shares(units: DataFrame, pages: DataFrame) -> DataFrame:
    """units(doc_id, page_index, para_index, source, formula) and pages(doc_id, page_index, text) -> units but formulas, with translated.

    A page's text without white space is dealt to its paragraphs in proportion to their lengths: each takes its rounded share, LEAST
    characters at least, from where the shares before it end. Where nothing is left, or the page has no text, it is the marked source."""
    page = Window.partitionBy("doc_id", "page_index")
    before = page.orderBy("para_index").rowsBetween(Window.unboundedPreceding, -1)
    u = units.where(~F.coalesce("formula", F.lit(False))).select("doc_id", "page_index", "para_index", F.coalesce("source", F.lit("")).alias("source"))
    u = u.withColumn("_n", X.utf16_length(F.col("source")))
    texts = pages.select("doc_id", "page_index", X.squeeze(F.col("text")).alias("_text"))
    u = u.join(texts, ["doc_id", "page_index"], "left")
    share = F.floor(F.col("_n") / F.greatest(F.sum("_n").over(page), F.lit(1)) * F.length("_text") + 0.5).cast("int")
    u = u.withColumn("_share", share).withColumn("_at", F.coalesce(F.sum("_share").over(before), F.lit(0)))
    cut = F.substring("_text", F.col("_at").cast("int") + 1, F.greatest("_share", F.lit(LEAST)))
    return u.select("doc_id", "page_index", "para_index", "source", _or_marked(cut).alias("translated"))


def by_position(units: DataFrame, texts: DataFrame) -> DataFrame:
    """units, with translated from texts(doc_id, key, translated), whose keys are page:paragraph counted from 0; null where there is none."""
    key = F.concat_ws(":", F.col("page_index").cast("string"), F.col("para_index").cast("string"))
    return units.withColumn("key", key).join(texts.select("doc_id", "key", "translated"), ["doc_id", "key"], "left").drop("key")


def by_source(units: DataFrame, cache: DataFrame) -> DataFrame:
    """units but formulas, with the newest text that a cache(key, translated, ord) of any namespace holds for an equal source, and hit."""
    rows = cache.where(F.col("translated").isNotNull()).select(F.regexp_extract("key", "([0-9a-f]{32})$", 1).alias("_hash"), "translated", "ord")
    newest = rows.groupBy("_hash").agg(F.max_by("translated", "ord").alias("translated"))
    u = units.where(~F.coalesce("formula", F.lit(False))).withColumn("_hash", X.hash128(F.col("source")))
    return u.join(newest, "_hash", "left").drop("_hash").withColumn("hit", F.col("translated").isNotNull())


def hits(found: DataFrame) -> DataFrame:
    """Per document: units found and missed."""
    return found.groupBy("doc_id").agg(F.count_if("hit").alias("hit"), F.count_if(~F.col("hit")).alias("miss"))


def _or_marked(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.concat(F.lit(MARK), F.col("source")))
