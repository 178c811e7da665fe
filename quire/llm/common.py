"""Shared helpers: table access, folds, tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java character class; words are runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-quire-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir is unset: executors share no folder with the driver")
    return (given or _own_dir()).rstrip("/")


def materialise(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    batch_rows: most rows in an Arrow batch while it is written, where rows hold whole texts."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that materialise wrote, once everything made of it has been written too."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hashed_share(key: Column, bound: int, total: int, salt: int = 0) -> Column:
    """True for about bound of total rows, chosen by a hash of key: a sample of bounded size without a sort or a shuffle."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 40)) < int(min(1.0, bound / max(total, 1)) * (1 << 40))


def order_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order."""
    bits = (x + 0.0).view(np.int64)  # -0.0 becomes 0.0
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def from_order_bits(bits: np.ndarray) -> np.ndarray:
    return (bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))).view(np.float64)


def quantiles(rows: DataFrame, key: str, bits: str, qs: list[float]) -> dict:
    """For each key (whole numbers), the quantiles qs of all its values, exactly as numpy.quantile has them; bits: the column with order_bits of the values.

    Four rounds find 16 bits each of the order statistics by counts of values, of which at most 2 ** 16 are of one key and rank: nothing is sorted
    as a whole or held by one task. The driver gets one row a key and rank."""
    n = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    wanted = sorted({(k, 0, at, at) for k, c in n.items() for q in qs for at in (int(q * (c - 1)), min(int(q * (c - 1)) + 1, c - 1))})
    for shift in (48, 32, 16, 0):
        if not wanted:
            break
        ranks = F.broadcast(rows.sparkSession.createDataFrame(wanted, "key long, prefix long, rest long, rank long"))
        prefix = F.shiftright(bits, shift + 16) if shift < 48 else F.lit(0).cast("long")
        own = rows.select(F.col(key).cast("long").alias("key"), prefix.alias("prefix"), F.shiftright(bits, shift).alias("digit")).join(ranks.select("key", "prefix").distinct().hint("broadcast"), ["key", "prefix"], "left_semi")
        upto = own.groupBy("key", "prefix", "digit").count().withColumn("upto", F.expr("sum(count) OVER (PARTITION BY key, prefix ORDER BY digit)"))
        found = upto.join(ranks, ["key", "prefix"]).where("rest < upto AND rest >= upto - count")
        wanted = [tuple(r) for r in found.select("key", "digit", F.expr("rest - (upto - count)"), "rank").collect()]
    value = dict(zip(((k, rank) for k, _, _, rank in wanted), from_order_bits(np.array([w[1] for w in wanted], np.int64)).tolist(), strict=True))
    out = {}
    for k, c in n.items():
        at = [(int(q * (c - 1)), min(int(q * (c - 1)) + 1, c - 1), q * (c - 1) % 1) for q in qs]
        out[k] = [value[k, a] + (value[k, b] - value[k, a]) * part for a, b, part in at]
    return out


def release() -> None:
    """Give what is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own habits
        pass


_WORKER_TABLES: dict[str, dict] = {}


def worker_tables(name: str) -> dict:
    """An operator's own tables in this Python worker. Workers outlive tasks, so tables of other operators are dropped here,
    and what Arrow holds back for later goes to the system again."""
    if name not in _WORKER_TABLES:
        _WORKER_TABLES.clear()
        _WORKER_TABLES[name] = {}
        release()
    return _WORKER_TABLES[name]


def slices(lengths, budget: int):
    """Index ranges of consecutive items whose lengths sum to about budget at most (one item at least)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
