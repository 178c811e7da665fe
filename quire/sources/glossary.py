"""Terminology lists from delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X

MAX_ENTRIES = 500


def parse_lines(lines: DataFrame, limit: int = MAX_ENTRIES) -> DataFrame:
    """lines(ord, line) -> ord, source, target: blank lines and comments are skipped, a tab separates before a comma does,
    both sides must be there, the first of terms that differ in case only wins, and limit entries are kept."""
    t = lines.select("ord", X.strip(F.col("line")).alias("t")).where("t <> '' AND NOT startswith(t, '#')")
    k = F.when(F.contains("t", F.lit("\t")), F.instr("t", "\t")).otherwise(F.instr("t", ","))
    e = t.withColumn("k", k).where("k > 1")
    e = e.select("ord", X.strip(F.expr("substring(t, 1, k - 1)")).alias("source"), X.strip(F.expr("substring(t, k + 1)")).alias("target")).where("source <> '' AND target <> ''")
    first = e.withColumn("rn", F.expr("row_number() OVER (PARTITION BY lower(source) ORDER BY ord)")).where("rn = 1").drop("rn")
    return first.orderBy("ord").limit(limit)


def read_glossary(spark: SparkSession, path: str, limit: int = MAX_ENTRIES) -> DataFrame:
    """A terminology file. The list is small by contract; line order comes from splitting each whole file."""
    whole = spark.read.text(path, wholetext=True)
    return parse_lines(whole.select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line")), limit)
