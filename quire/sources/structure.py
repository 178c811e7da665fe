"""Interchange of page structure as JSON lines, binary files, and the cache and checkpoint tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "STRUCT<left: DOUBLE, top: DOUBLE, right: DOUBLE, bottom: DOUBLE>"
OUTLINES = "ARRAY<STRUCT<path: STRING, x: DOUBLE, y: DOUBLE>>"
SCHEMAS = {
    "runs": f"doc_id STRING, page_index INT, ord INT, text STRING, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, font_name STRING, font_id STRING, font_size DOUBLE, baseline DOUBLE, is_math BOOLEAN, outlines {OUTLINES}",
    "draw_ops": "doc_id STRING, page_index INT, seq INT, op STRING, args ARRAY<DOUBLE>, bounds ARRAY<DOUBLE>",
    "pages": f"doc_id STRING, page_index INT, width DOUBLE, height DOUBLE, rotate INT, view ARRAY<DOUBLE>, skipped BOOLEAN, image_count INT, protected_regions ARRAY<{BOX}>, shaded_regions ARRAY<STRUCT<box: {BOX}, color: ARRAY<DOUBLE>>>",
    "paragraphs": f"doc_id STRING, page_index INT, para_index INT, source STRING, col INT, is_formula_block BOOLEAN, box {BOX}, line_boxes ARRAY<{BOX}>, baselines ARRAY<DOUBLE>, font_size DOUBLE, leading DOUBLE, bold BOOLEAN, alignment STRING, math ARRAY<STRUCT<token: STRING, text: STRING, box: {BOX}, font_size: DOUBLE, baseline: DOUBLE, outlines: {OUTLINES}>>",
    "cache": "version INT, namespace STRING, key STRING, translated STRING, ord BIGINT",
    "checkpoint": "doc_key STRING, namespace STRING, version INT, saved_at TIMESTAMP, unit_key STRING, translated STRING",
}
CACHE_VERSION = 3
RESUME_DAYS = 7


def read_structure(spark: SparkSession, path: str, kind: str, first_page: int = 0, last_page: int = 0) -> DataFrame:
    """Rows of a structure dump; pages are counted from 1 and 0 leaves a side open. Rows that don't parse are nulls in their fields."""
    df = spark.read.schema(SCHEMAS[kind]).json(path)
    if "page_index" in df.columns:
        if first_page:
            df = df.where(F.col("page_index") >= first_page - 1)
        if last_page:
            df = df.where(F.col("page_index") <= last_page - 1)
    return df


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Whole files: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def read_cache(spark: SparkSession, path: str, namespace: str, version: int = CACHE_VERSION) -> DataFrame:
    """Entries of a namespace; another version reads as empty."""
    return spark.read.schema(SCHEMAS["cache"]).parquet(path).where((F.col("version") == version) & (F.col("namespace") == namespace) & F.col("translated").isNotNull())


def read_checkpoint(spark: SparkSession, path: str, doc_key: str | None, namespace: str, version: int = 1, days: int = RESUME_DAYS, now=None) -> DataFrame:
    """Newest translation of each unit that is not older than days, of the namespace and version."""
    now = F.current_timestamp() if now is None else F.lit(now)
    rows = spark.read.schema(SCHEMAS["checkpoint"]).parquet(path).where((F.col("version") == version) & (F.col("namespace") == namespace) & (F.col("saved_at") >= now - F.expr(f"INTERVAL {days} DAYS")))
    if doc_key is not None:
        rows = rows.where(F.col("doc_key") == doc_key)
    return rows.groupBy("doc_key", "unit_key").agg(F.max_by("translated", "saved_at").alias("translated"))
