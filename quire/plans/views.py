"""Adapter views over the driver tables: DataFrames, and the same definitions as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, para_index, source: lines of documents, blanks dropped after numbering."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("para_index", "source")).where(~X.is_blank(F.col("source")))


def units_ph(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    p = F.col("para_index")
    marked = F.concat("source", F.when(p % 3 == 0, F.lit(" ⟦M1⟧")).otherwise(F.lit("")), F.when(p % 9 == 0, F.lit(" ⟦M2⟧")).otherwise(F.lit("")))
    return units(spark, sf_dir, keep).withColumn("source", marked)


def replies(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """units_ph with a reply of eight kinds: missing, empty, echo, cut, marked, unbalanced, renumbered, duplicated token."""
    kind = (F.col("doc_id") * 31 + F.col("para_index")) % 8
    s = F.col("source")
    reply = (
        F.when(kind == 1, F.lit(""))
        .when(kind == 2, s)
        .when(kind == 3, F.substring(s, 1, 5))
        .when(kind == 4, F.concat(F.lit("【译】"), s))
        .when(kind == 5, F.concat(s, F.lit("(")))
        .when(kind == 6, F.replace(s, F.lit("⟦M1⟧"), F.lit("⟦M01⟧")))
        .when(kind == 7, F.concat(s, F.lit(" ⟦M1⟧")))
    )
    return units_ph(spark, sf_dir, keep).withColumn("reply", reply)


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, source, target: the first two words of benchmark texts, first of each lower-cased term."""
    first = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    terms = read(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("ord"), first.alias("source"))
    return terms.withColumn("rn", F.expr("row_number() OVER (PARTITION BY lower(source) ORDER BY ord)")).where("rn = 1").select("ord", "source", X.upper(F.col("source")).alias("target"))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, translated, ord: lines of even documents, first of equal lines."""
    lines = units(spark, sf_dir).where("doc_id % 2 = 0").groupBy("source").agg(F.min(F.struct("doc_id", "para_index")).alias("k"))
    return lines.select("source", F.concat(F.lit("T:"), "source").alias("translated"), (F.col("k.doc_id") * 100000 + F.col("k.para_index")).alias("ord"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per line of a document, as on a page."""
    p = F.col("para_index")
    return units(spark, sf_dir).select(
        "doc_id", "para_index", F.col("source").alias("text"), F.when(p % 5 == 4, F.lit(46.0)).otherwise(F.lit(40.0)).alias("x"), (40.0 + 13.0 * p).alias("y"),
        F.least(5.0 * F.length("source"), F.lit(520.0)).alias("width"), F.when(p == 0, F.lit(11.0)).otherwise(F.lit(10.0)).alias("size"), F.when(p % 7 == 6, F.lit(1)).otherwise(F.lit(0)).alias("col"),
    )


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    order = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
    return rows.withColumn("id", F.expr(f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {order})"))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li(spark, sf_dir).select(F.col("l_orderkey").alias("page"), "id", F.least(F.col("l_partkey") % 4 - 1, F.lit(1)).alias("col"), F.col("l_quantity").alias("y"), F.col("l_linenumber").cast("double").alias("x"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = li(spark, sf_dir).select(F.col("l_orderkey").alias("page"), "id", (10 * F.col("l_quantity")).alias("left"), (80.0 * F.col("l_linenumber")).alias("top"), "l_discount", "l_tax", (F.col("l_partkey") % 3).alias("kind"))
    return b.select("page", "id", "left", "top", (F.col("left") + 20 + 500 * F.col("l_discount")).alias("right"), (F.col("top") + 12 + 100 * F.col("l_tax")).alias("bottom"), "kind")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, v: gap centres, whole points so that sums and ties are exact."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.floor(F.col("l_extendedprice") % 400).cast("long").alias("v"))


W = X.WHITE
SQL = {
    "units": f"""units AS (SELECT doc_id, lang, src, CAST(p - 1 AS INTEGER) AS para_index, source FROM (
      SELECT doc_id, lang, source AS src, unnest(string_split(text, chr(10))) AS source, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL) t
      WHERE length(regexp_replace(source, '{W}', '', 'g')) > 0)""",
    "units_ph": """units_ph AS (SELECT doc_id, lang, src, para_index, source || CASE WHEN para_index % 3 = 0 THEN ' ⟦M1⟧' ELSE '' END || CASE WHEN para_index % 9 = 0 THEN ' ⟦M2⟧' ELSE '' END AS source FROM units)""",
    "replies": """replies AS (SELECT *, CASE (doc_id * 31 + para_index) % 8 WHEN 1 THEN '' WHEN 2 THEN source WHEN 3 THEN substr(source, 1, 5) WHEN 4 THEN '【译】' || source
      WHEN 5 THEN source || '(' WHEN 6 THEN replace(source, '⟦M1⟧', '⟦M01⟧') WHEN 7 THEN source || ' ⟦M1⟧' END AS reply FROM units_ph)""",
    "glossary": """glossary AS (SELECT ord, source, upper(source) AS target FROM (SELECT item_id AS ord, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS source,
      row_number() OVER (PARTITION BY lower(array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ')) ORDER BY item_id) AS rn FROM benchmark WHERE text IS NOT NULL) t WHERE rn = 1)""",
    "cache": """cache AS (SELECT source, 'T:' || source AS translated, min(doc_id * 100000 + para_index) AS ord FROM units WHERE doc_id % 2 = 0 GROUP BY source)""",
    "runs": """runs AS (SELECT doc_id, para_index, source AS text, CASE WHEN para_index % 5 = 4 THEN 46.0::DOUBLE ELSE 40.0::DOUBLE END AS x, 40.0::DOUBLE + 13.0::DOUBLE * para_index AS y,
      least(5.0::DOUBLE * length(source), 520.0::DOUBLE) AS width, CASE WHEN para_index = 0 THEN 11.0::DOUBLE ELSE 10.0::DOUBLE END AS size, CASE WHEN para_index % 7 = 6 THEN 1 ELSE 0 END AS col FROM units)""",
    "li": """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS id FROM lineitem)""",
    "columns": """cols AS (SELECT l_orderkey AS page, id, least(l_partkey % 4 - 1, 1) AS col, l_quantity AS y, l_linenumber::DOUBLE AS x FROM li)""",
    "boxes": """boxes AS (SELECT page, id, l AS "left", t AS top, l + 20 + 500 * l_discount AS "right", t + 12 + 100 * l_tax AS bottom, kind FROM (
      SELECT l_orderkey AS page, id, 10 * l_quantity AS l, 80.0::DOUBLE * l_linenumber AS t, l_discount, l_tax, l_partkey % 3 AS kind FROM li) q)""",
    "votes": """votes AS (SELECT l_suppkey AS page, CAST(floor(l_extendedprice % 400) AS BIGINT) AS v FROM lineitem)""",
}
NEEDS = {"units_ph": ["units"], "replies": ["units", "units_ph"], "cache": ["units"], "runs": ["units"], "columns": ["li"], "boxes": ["li"]}


def with_(*names: str, more: str = "", recursive: bool = False) -> str:
    """A WITH clause of the named views, those they need first, and more common table expressions."""
    order: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    parts = [SQL[n] for n in order] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
