"""Sinks: output names, cache, checkpoint, decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.sources.structure import CACHE_VERSION, SCHEMAS

CACHE_ENTRIES = 60_000
MAX_NAMES = 499
#: Parts of a checkpoint table: clearing a document writes one of them anew.
BUCKETS = 16


def output_names(docs: DataFrame, suffix: str = ".bilingual", custom: str = "", storage: str = "", extension: str = ".pdf", overwrite: bool = False, most: int | None = MAX_NAMES) -> DataFrame:
    """docs(doc_id, mode, path) -> doc_id, mode, dir, path, in_storage: routed by mode, and numbered where names collide, up to most; more are an error.
    most: None numbers all. overwrite: names aren't numbered."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    where = F.when(F.col("mode") == "custom", F.lit(custom.strip())).when(F.col("mode") == "storage", F.lit(storage)).otherwise(parent)
    rows = docs.select("doc_id", "mode", where.alias("dir"), X.safe_stem(X.file_stem(F.col("path"))).alias("stem"))
    rows = rows.withColumn("k", F.lit(1) if overwrite else F.row_number().over(Window.partitionBy("dir", "stem").orderBy("doc_id")))
    number = F.when(F.col("k") == 1, F.lit("")).otherwise(F.concat(F.lit(" ("), F.col("k").cast("string"), F.lit(")")))
    if most is not None:
        number = F.when(F.col("k") > most, F.raise_error(F.concat(F.lit("Too many outputs are named "), "dir", F.lit("/"), "stem"))).otherwise(number)
    path = F.when(F.col("mode").isin("custom") & F.lit(not custom.strip()), F.raise_error(F.lit("No output folder is configured."))).otherwise(F.concat("dir", F.lit("/"), "stem", F.lit(suffix), number, F.lit(extension)))
    return rows.select("doc_id", "mode", "dir", path.alias("path"), (F.col("mode") == "storage").cast("int").alias("in_storage"))


def write_cache(entries: DataFrame, path: str, namespace: str, keep: int = CACHE_ENTRIES) -> None:
    """entries(key, translated, ord): the newest keep of them, replacing the namespace's table."""
    newest = entries.orderBy(F.desc("ord")).limit(keep)
    newest.select(F.lit(CACHE_VERSION).alias("version"), F.lit(namespace).alias("namespace"), "key", "translated", F.col("ord").cast("long").alias("ord")).write.mode("overwrite").parquet(path)


def append_checkpoint(results: DataFrame, path: str, namespace: str, version: int = 1, batch: str | None = None) -> None:
    """results(doc_key, unit_key, translated) go to their documents' buckets. A batch that is written again takes its own place and no other; without
    a name it is a batch of its own. Readers take the newest entry of a unit."""
    restore_checkpoint(results.sparkSession, path)
    rows = results.select("doc_key", F.lit(namespace).alias("namespace"), F.lit(version).alias("version"), F.current_timestamp().alias("saved_at"), "unit_key", "translated")
    placed = rows.withColumn("bucket", _bucket(F.col("doc_key"))).withColumn("batch", F.lit(batch or uuid.uuid4().hex))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def _bucket(doc_key: Column) -> Column:
    return F.pmod(F.xxhash64(doc_key), F.lit(BUCKETS)).cast("int")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and what makes paths for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _move(spark: SparkSession, old: str, new: str) -> None:
    files, at = _files(spark, old)
    if not files.rename(at(old), at(new)):
        raise OSError(f"{old} could not be moved to {new}")


def restore_checkpoint(spark: SparkSession, path: str) -> None:
    """Undo a clear that stopped between its two moves: a bucket that was set aside and not replaced goes back; one that was is removed."""
    files, at = _files(spark, path)
    for found in files.globStatus(at(f"{path.rstrip('/')}/_old-bucket=*")) or []:
        old = found.getPath().toString()
        here = old.replace("/_old-bucket=", "/bucket=")
        if files.exists(at(here)):
            files.delete(at(old), True)
        else:
            _move(spark, old, here)


def clear_checkpoint(spark: SparkSession, path: str, doc_key: str, namespace: str) -> None:
    """The document's entries of the namespace are gone, once its output stands. Only its bucket is written anew, beside the table; the old bucket is
    set aside before the new one takes its place, and removed last, so that nothing is lost wherever this stops."""
    restore_checkpoint(spark, path)
    files, at = _files(spark, path)
    bucket = spark.range(1).select(_bucket(F.lit(doc_key))).first()[0]
    root, here = path.rstrip("/"), f"{path.rstrip('/')}/bucket={bucket}"
    if not files.exists(at(here)):
        return
    rows = spark.read.schema(f"{SCHEMAS['checkpoint']}, batch STRING").parquet(here)
    new = f"{root}/_new-{uuid.uuid4().hex}"
    rows.where(~(F.col("doc_key").eqNullSafe(doc_key) & F.col("namespace").eqNullSafe(namespace))).write.partitionBy("batch").parquet(new)
    _move(spark, here, f"{root}/_old-bucket={bucket}")
    _move(spark, new, here)
    restore_checkpoint(spark, path)


def append_log(lines: DataFrame, path: str) -> None:
    """lines(message) with the time they were written, appended."""
    lines.select(F.current_timestamp().alias("at"), "message").write.mode("append").parquet(path)


def write_structure(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows of the interchange shape (runs, lines, paragraphs or decisions by doc_id and page_index) as JSON lines that read_structure reads."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path, ignoreNullFields=False)


def write_decisions(decided: DataFrame, path: str, overwrite: bool = False) -> None:
    decided.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
