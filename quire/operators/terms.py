"""Terminology: which terms occur in which units, and a batch's terminology block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

#: Most terms of a block.
BLOCK_TERMS = 40
#: First words of terms up to which they are one list that every text is compared with.
MAX_LISTED = 5_000


def matches(units: DataFrame, glossary: DataFrame) -> DataFrame:
    """units(doc_id, para_index, source) with the terms they contain: ord, term, target.

    A term that starts with letters or digits can only match where its first run of them is a run of the text, so
    units meet terms by equality on that run and the whole term is tested afterwards. Terms without such a start are few and are tested against every unit."""
    run = r"^[a-z0-9]+"
    g = glossary.select("ord", F.col("source").alias("term"), "target", F.regexp_extract(F.lower("source"), run, 0).alias("first")).withColumn("ascii", F.col("term").rlike(r"^[\x20-\x7e]+$"))
    keyed, free = g.where("ascii AND first <> ''"), g.where("NOT (ascii AND first <> '')")
    u = units.select("doc_id", "para_index", "source")
    listed = [r["first"] for r in keyed.select("first").distinct().limit(MAX_LISTED + 1).collect()]
    firsts = keyed.groupBy("first").agg(F.collect_list(F.struct("ord", "term", "target")).alias("terms"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("source"), F.lit("([a-z0-9]+)"), F.lit(1)))
    if len(listed) <= MAX_LISTED:  # texts stay where they are: only words that a listed term begins with become rows
        met = u.withColumn("first", F.explode(F.array_intersect(words, F.lit(listed).cast("array<string>")))).join(F.broadcast(firsts), "first")
    else:  # only words travel, texts come back for those that met
        keys = u.select("doc_id", "para_index", F.explode(words).alias("first")).join(firsts, "first").groupBy("doc_id", "para_index").agg(F.flatten(F.collect_list("terms")).alias("terms"))
        met = u.join(keys, ["doc_id", "para_index"])
    met = met.select("doc_id", "para_index", "source", F.inline("terms")).where(F.contains(F.lower("source"), F.lower("term")))
    rest = u.join(free, X.contains_term(F.col("term"), F.col("source"))).select(*met.columns)
    return met.where(X.contains_term(F.col("term"), F.col("source"))).unionByName(rest).select("doc_id", "para_index", "ord", "term", "target")


def blocks(matched: DataFrame, limit: int = BLOCK_TERMS) -> DataFrame:
    """matched(doc_id, batch, ord, term, target) -> the first limit terms of each batch as a prompt block."""
    terms = matched.select("doc_id", "batch", "ord", "term", "target").distinct()
    first = terms.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "batch").orderBy("ord"))).where(F.col("k") <= limit)
    line = F.concat(F.lit("- "), "term", F.lit(" → "), "target")
    per = first.groupBy("doc_id", "batch").agg(F.count("*").alias("terms"), F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"))
    return per.select("doc_id", "batch", "terms", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("block"))
